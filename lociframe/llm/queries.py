"""The registered queries of the text operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fim, html_text, jaccard, linededup, packing, phrases, pii, quality, resample, runindex, substring, winnow
from .common import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(documents(spark, sf_dir))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.verdicts(documents(spark, sf_dir), either=True, least_words=quality.LEAST_WORDS)
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), tokenizer_path())


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).select("doc_id", "n_words", "log_weight", "gumbel_key", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(documents(spark, sf_dir), tokenizer_path())


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(documents(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.printed_spans(pii.personal_data(documents(spark, sf_dir)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.without_repeated_runs(documents(spark, sf_dir), long_words=linededup.LONG_WORDS)
    return kept.selectExpr("doc_id", "n_lines", "n_removed_lines", "sha2(coalesce(text, ''), 256) as kept_sha256")


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.without_earlier_strings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, sf_dir))
    return made.selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(output, 256) as output_sha256", f"sha2({fim.restored()}, 256) as restored_sha256")


QUERIES = {f.__name__: f for f in (op1_winnowing, op2_line_frequency, op3_jaccard_join, op4_best_fit_packing, op5_importance_resampling, op6_substring_dedup, op7_bpe, op8_html_layout, op9_personal_data, op10_line_dedup, op11_suffix_array, op12_collocations, op13_fill_in_middle)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op2_line_frequency": rf"""
with d as (select doc_id, coalesce(source, '') host, coalesce(text, '') t, {_WORDS} w from documents),
g as (select doc_id, len(w) n, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) gram, unnest(range(1, len(w) - 1)) i from d where len(w) >= 3),
often as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) c from g) where c > 1),
repeated as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from often) group by 1),
raw as (select doc_id, host, md5(t) k, unnest(string_split(t, chr(10))) line from d),
worded as (select doc_id, count(*) - count(distinct line) n from raw where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
lines as (select doc_id, host, k, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) l from raw),
counted as (select doc_id, host, k, l, len(regexp_extract_all(l, '[^ ]+')) n from lines where l <> ''),
hosts as (select host, count(distinct md5(t)) n from d group by 1),
frequent as (select host, l from (select host, l, count(distinct k) c from counted group by 1, 2) join hosts using (host) where c > {quality.ENOUGH_DOCS} or (c > {quality.FLOOR_DOCS} and c > n * {quality.FLOOR_SHARE}::double)),
gone as (select doc_id, sum(n) n from counted join frequent using (host, l) group by 1),
s as (select d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
  coalesce(worded.n, 0) n_dup_lines, coalesce(repeated.n, 0) n_repeat_words, cast(coalesce(gone.n, 0) as bigint) n_frequent_words
  from d left join worded using (doc_id) left join repeated using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (n_words - n_frequent_words < n_words * {quality.LEAST_LEFT} or n_words - n_frequent_words < {quality.LEAST_WORDS}) as kept, n_frequent_words from s""",
    "op3_jaccard_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) g from d)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 90 * (nx.n + ny.n - c)),
b as (select x, y from e union select y, x from e),
r as (select doc_id x, doc_id y from d union select r.x, b.y from r join b on r.y = b.x)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id from d left join n using (doc_id) join (select x, min(y) c from r group by 1) m on m.x = d.doc_id""",
    "op6_substring_dedup": rf"""
with d as (select doc_id, {_WORDS} w from documents),
g as (select doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) h, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) c from g) where c > 1),
gone as (select doc_id, list(distinct p) ps from (select doc_id, unnest(range(i, i + 35)) p from twice) group by 1),
stay as (select d.doc_id, len(w) n_words, case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end k from d left join gone using (doc_id))
select doc_id, n_words, n_words - len(k) n_removed, sha256(array_to_string(k, ' ')) kept_sha256 from stay""",
    "op10_line_dedup": rf"""
with d as (select doc_id, coalesce(text, '') t, string_split(coalesce(text, ''), chr(10)) raw from documents),
l as (select doc_id, unnest(raw) line, unnest(range(1, len(raw) + 1)) i from d),
c as (select doc_id, i, trim(lower(line), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) l from l),
w as (select doc_id, i, l, lead(i) over x i2, lead(l) over x l2 from c where l <> '' window x as (partition by doc_id order by i)),
f as (select doc_id, i, i2, min((doc_id, i)) over (partition by l, l2) first from w where i2 is not null),
o as (select *, count(*) over (partition by doc_id) = 1 or len(regexp_extract_all(l, '[^ \t\r\x0B\x0C]+')) >= {linededup.LONG_WORDS} own, min((doc_id, i)) over (partition by l) first from c where l <> ''),
gone as (select doc_id, list(distinct p) ps from (select doc_id, unnest([i, i2]) p from f where (doc_id, i) > first union all select doc_id, i from o where own and (doc_id, i) > first) group by 1)
select d.doc_id, len(raw) n_lines, coalesce(len(ps), 0) n_removed_lines, sha256(case when ps is null then t else array_to_string(list_filter(raw, lambda x, i: not list_contains(ps, i)), chr(10)) end) kept_sha256
from d left join gone using (doc_id)""",
    "op13_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || doc_id) h from documents),
b as (select *, list_transform([1, 9, 17, 25], lambda a: list_sum(list_transform(range(8), lambda i: (position(h[a + i] in '0123456789abcdef') - 1) * (16 ** (7 - i))::bigint))::bigint) x from d),
c as (select *, least(x[1] % (n + 1), x[2] % (n + 1)) lo, greatest(x[1] % (n + 1), x[2] % (n + 1)) hi,
  case when t = '' or regexp_matches(t, '<[PSM]>') or x[3] % 100 >= 90 then 'plain' when x[4] % 100 < 20 then 'spm' else 'psm' end form from b),
o as (select *, t[:lo] p, t[lo + 1:hi] m, t[hi + 1:] s from c)
select doc_id, n, form, case when form <> 'plain' then lo end prefix_chars, case when form <> 'plain' then hi - lo end middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) output_sha256, sha256(t) restored_sha256 from o""",
    "op11_suffix_array": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) x, strlen(coalesce(text, '')) n from documents),
p as (select doc_id, n, p, substr(x, 2 * p + 1, 1198) x from (select *, unnest(range(0, n, 500)) p from d)),
b as (select doc_id, n, p, unnest(range(1, least(500, n - p) + 1)) j, x from p),
w as (select doc_id, p + j i, substr(x, 2 * j - 1, 2) b, case when p + j + 99 <= n then md5(substr(x, 2 * j - 1, 200)) end w from b),
e as (select *, w is not null and (doc_id, i) > min((doc_id, i)) over (partition by w) again from w),
c as (select *, coalesce(bool_or(again) over (partition by doc_id order by i rows between 99 preceding and current row), false) gone from e),
s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) head from c),
g as (select doc_id, count(*) filter (gone) n_removed, count(*) filter (head) n_spans, string_agg(b, '' order by i) filter (not gone) kept from s group by 1)
select doc_id, d.n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from d left join g using (doc_id)""",
    "op12_collocations": r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from d)),
g as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) phrase from p, (select unnest(range(1, 6)) m) where len(w) >= m),
f as (select lang, m, phrase, count(*) f from g group by 1, 2, 3),
n as (select lang, sum(f) n from f where m = 1 group by 1),
c as (select lang, m, phrase, f a, string_split(phrase, ' ') w from f where m > 1 and f >= 100),
k as (select *, unnest(range(1, m)) k from c),
s as (select k.lang, k.phrase, k.a, n.n, k.k, x.f l, y.f r, cast((1000::hugeint * k.a * n.n) // (x.f::hugeint * y.f) as bigint) score from k join n using (lang)
  join f x on x.lang = k.lang and x.phrase = array_to_string(k.w[1:k.k], ' ') join f y on y.lang = k.lang and y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select distinct p.lang, p.phrase from (select lang, m, a, unnest(list_transform(range(1, m), lambda j: list_transform(range(1, m - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' ')))) inner_phrases from c) q,
  unnest(q.inner_phrases) u(x) join c p on p.lang = q.lang and p.phrase = u.x where 100 * q.a >= 100 * p.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) n, score
from b anti join o using (lang, phrase) qualify rank <= 2000""",
}
