"""The text operators against brute force, on small corpora with nulls, copies, ties and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from lociframe.llm import bpe, html_text, jaccard, linededup, packing, pii, quality, resample, substring, winnow
from lociframe.llm.common import ship
from lociframe.llm.queries import tokenizer_path

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("class", T.StringType())])
WORD = re.compile("[^\x20\x09-\x0d]+")
VOCAB = [a + b for a in ("the", "of", "St", "é", "qu", "ion", "Ab") for b in ("er", "ing", "a", "o.", "ly", "9")]


def corpus() -> list[tuple]:
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    shared, line = text(50), text(6)
    texts = [None, "", " \n\t", "one", "two words"]
    for i in range(30):
        t = "\n".join(text(rng.randint(5, 40)) for _ in range(rng.randint(1, 8)))
        if i % 3 == 0:
            t += "\n" + line + "\n" + text(4)
        if i % 4 == 0:
            t = t[: len(t) // 2] + " " + shared + " " + t[len(t) // 2 :]
        texts.append(t)
    base = text(200)
    texts += [base, base, base]
    for k in (1, 1, 2, 3, 8):
        w = base.split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    texts += [text(6000), "x" * 20_000, "Mail a.b@c.de, call +49 (30) 1234-5678 now; 10.0.0.255 300.1.1.1 4111 1111 1111 1111 and 4111111111111112 x@y@z.org é@é.fr"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "k", "c") for i, t in enumerate(texts)]
    return [*rows, rows[10], (None, texts[12], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_window_minimum_is_rightmost():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        v = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
        w = rng.randint(1, 12)
        expect = [max(range(i, i + w), key=lambda j: (-v[j], j)) for i in range(len(v) - w + 1)]
        from lociframe.llm.common import rolling, window_argmin_right

        assert window_argmin_right(np.array(v, np.uint64), w).tolist() == expect
        h = np.array(v, np.uint64)
        assert len(rolling(h, w)) == max(0, len(v) - w + 1)
        seen = {}
        for i, x in enumerate(rolling(h, w).tolist()):
            assert seen.setdefault(tuple(v[i : i + w]), x) == x


def test_winnowing_guarantee():
    rng = random.Random(2)
    letters = "abcdefgh é"
    for _ in range(30):
        common = "".join(rng.choice(letters) for _ in range(winnow.K + winnow.W - 1))
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) + common
        b = common + "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        assert set(winnow.fingerprint(a)[1].tolist()) & set(winnow.fingerprint(b)[1].tolist())


def test_op1(docs, none):
    assert winnow.edited_fingerprints(none).count() == 0
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    got = defaultdict(list)
    for r in winnow.edited_fingerprints(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, r in enumerate(rows):
        t, nxt = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        x = next(x for x in got[r[0]] if x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        assert x.n_chars == len(t)
        assert x.fingerprint == winnow.printed(*winnow.fingerprint(t))
        assert abs(x.near_edited - winnow.likeness(winnow.fingerprint(t)[1], winnow.fingerprint(edited)[1])) < 1e-12
        assert abs(x.near_next - winnow.likeness(winnow.fingerprint(t)[1], winnow.fingerprint(nxt)[1])) < 1e-12
    assert winnow.fingerprints(docs).count() == len(rows)


def test_op2(docs, none):
    assert quality.verdicts(none).count() == 0 and quality.quality_rules(none).count() == 0
    rows = corpus()
    df, hosts = defaultdict(set), defaultdict(set)
    for r in rows:
        hosts[r[3] or ""].add(r[1] or "")
        for x in {quality.normalised_line(y) for y in (r[1] or "").split("\n")} - {""}:
            df[r[3] or "", x].add(r[1] or "")
    got = {(r.doc_id, r.n_words): r for r in quality.verdicts(docs, min_docs=2, host_share=0.1).collect()}
    kept = Counter()
    for r in rows:
        t, w = r[1] or "", words(r[1])
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(g)
        repeat = {j for i, x in enumerate(g) if c[x] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(y.split()) for x in t.split("\n") if (y := quality.normalised_line(x)) and len(df[r[3] or "", y]) > max(2, 0.1 * len(hosts[r[3] or ""])))
        x = got[r[0], len(w)]
        assert (x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert x.base_failed == (len(w) < 50 or 2 * len(repeat) > len(w))
        assert x.kept == (not x.base_failed and len(w) - gone >= len(w) / 2)
        kept[r[0]] += x.kept
    out = quality.quality_rules(docs, min_docs=2, host_share=0.1)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +kept


def test_verdicts_by_either_limit(docs):
    rows = corpus()
    df, hosts = defaultdict(set), defaultdict(set)
    for r in rows:
        hosts[r[3] or ""].add(r[1] or "")
        for x in {quality.normalised_line(y) for y in (r[1] or "").split("\n")} - {""}:
            df[r[3] or "", x].add(r[1] or "")
    got = {(r.doc_id, r.n_words): r for r in quality.verdicts(docs, either=True, least_words=60).collect()}
    some = 0
    for r in rows:
        w, c = len(words(r[1])), lambda y: len(df[r[3] or "", y])  # noqa: B023
        low = lambda y: c(y) > quality.ENOUGH_DOCS or (c(y) > quality.FLOOR_DOCS and c(y) > quality.FLOOR_SHARE * len(hosts[r[3] or ""]))  # noqa: B023
        gone = sum(len(y.split()) for x in (r[1] or "").split("\n") if (y := quality.normalised_line(x)) and low(y))
        x = got[r[0], w]
        assert x.n_frequent_words == gone
        assert x.kept == (not x.base_failed and w - gone >= max(w / 2, 60))
        some += x.kept != (not x.base_failed)
    assert some


def test_either_limit_removes_shared_lines(spark):
    ship(spark)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    own = lambda n: " ".join(word() for _ in range(n))
    licence, rare = "This work is  licensed.", "seen twice"
    rows = []
    for host, docs, having in (("large", 1000, 40), ("small", 30, 3)):  # 4 % of a large host, 10 % of a small one
        rows += [(len(rows) + i, own(60) + (f"\n{licence}\n" if i < having else "\n") + own(5) + (f"\n{rare}" if i < 2 else ""), host) for i in range(docs)]
    copied = [own(12) for _ in range(6)]
    copies = range(len(rows), len(rows) + 9)
    rows += [(i, "\n".join([*copied, own(12)]), "large") for i in copies]
    out = {r.doc_id: r.text for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert len(out) == len(rows)
    assert not any(licence in t for t in out.values()) and sum(rare in t for t in out.values()) == 4
    assert all(out[i] == rows[i][1] for i in copies)  # near copies keep their lines: they are for a later stage
    assert all(out[i] == "\n".join(x for x in t.split("\n") if x != licence) for i, t, _ in rows)


def components(rows, n, share):
    sets = []
    for r in rows:
        w = [x.encode().lower() for x in words(r[1])]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= share * len(sets[i] | sets[j]) - 1e-9:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return sets, group


def test_op3(docs, none):
    assert jaccard.similarity_components(none).count() == 0 and jaccard.keep_one(none).count() == 0
    for n, num, den in ((3, 9, 10), (5, 4, 5), (2, 1, 2)):
        rows = corpus()
        sets, group = components(rows, n, num / den)
        expect = Counter()
        for r, s, g in zip(rows, sets, group, strict=True):
            ids = [x[0] for x, h in zip(rows, group, strict=True) if h == g and x[0] is not None]
            expect[r[0], len(s), min(ids) if s else r[0]] += 1
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_components(docs, n=n, num=num, den=den).collect())
        assert got == expect
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("text is not null and length(trim(text)) > 2").count() == len({g for g, s in zip(*reversed(components(corpus(), 3, 0.9)), strict=True) if s})


def test_prefix_arithmetic():
    for size in range(1, 60):
        for num, den in ((9, 10), (4, 5), (1, 2)):
            least = -((-num * size) // den)
            assert jaccard.prefix_length(size, num, den) == size - least + 1
            for other in range(1, 60):
                need = jaccard.required(size, other, num, den)
                assert need * (num + den) >= num * (size + other) > (need - 1) * (num + den)


def test_bin_completion():
    rng = random.Random(3)
    for trial in range(60):
        cap = rng.choice((10, 50, 100))
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 60)))
        packed = packing.completion(counts, cap)
        back = Counter()
        for p in packed:
            assert sum(p.lengths) <= cap and list(p.lengths) == sorted(p.lengths, reverse=True)
            for k in p.lengths:
                back[k] += p.times
        assert back == counts
        n = sum(p.times for p in packed)
        assert n <= sum(p.times for p in packing.best_fit_decreasing(counts, cap))
        assert -(-sum(k * v for k, v in counts.items()) // cap) <= n


def test_op4(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    assert packing.packed_documents(none, path).count() == 0
    tok = Tokenizer.from_file(path)
    expect = Counter()
    for r in corpus():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for i, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            expect[r[0], i, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    rows = packing.packed_documents(docs, path, capacity=512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in rows) // 512) + 1


def test_op5(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5, 35)], "doc_id bigint, quality int, toxic int")
    assert resample.resample(none, labels).count() == 0
    rows = resample.resample(docs, labels, share=0.5).collect()
    assert len(rows) == len(corpus())
    worded = [r for r in rows if r.n_words]
    cut = sorted((r.gumbel_key for r in worded), reverse=True)[round(0.5 * len(worded)) - 1]
    assert all(r.kept == bool(r.n_words and r.gumbel_key >= cut) for r in rows)


def test_resampling_prefers_the_target(spark):
    ship(spark)
    rng = random.Random(8)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    out = resample.resample(docs, labels).where("doc_id >= 100").collect()
    assert sum(r.kept == bool(r.doc_id % 2) for r in out) >= 0.95 * len(out)  # held-out accuracy


def test_kth_highest(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 1, 2, 2, 2, 5, 9, -4)], "x double")
    for k, v in enumerate(sorted((3, 1, 2, 2, 2, 5, 9, -4), reverse=True), 1):
        assert resample.kth_highest(df, "x", k) == v


def test_op6(docs, none):
    assert substring.without_repeats(none).count() == 0
    for length, gram in ((35, 8), (6, 2)):
        rows = corpus()
        seen = Counter(tuple(w[i : i + length]) for r in rows for w in [words(r[1])] for i in range(len(w) - length + 1))
        expect = Counter()
        for r in rows:
            w = words(r[1])
            gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
            expect[r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(docs, length=length, gram=gram).collect())
        assert got == expect


def test_op7(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    assert bpe.encoded_digests(none, path).count() == 0
    tok, mine = Tokenizer.from_file(path), bpe.Bpe(path)
    odd = "ΑΣ Σίσυφος İI don't <|endoftext|>x\x1cy é  　 가각 🙂🙂 ﬁ ́"
    for t in [odd, *[r[1] or "" for r in corpus()]]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == mine.digest(t)[2] == tok.decode(ids, skip_special_tokens=False)
    got = Counter(bpe.encoded_digests(docs, path).collect())
    for r in corpus():
        e = tok.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0], len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()]
    back = bpe.decoded(bpe.encoded(docs, path), path)
    assert back.columns == [*docs.columns, "ids", "decoded"] and back.count() == len(corpus())


def test_pair_tree():
    rng = random.Random(4)
    ranks = [rng.randrange(5) for _ in range(33)]
    tree = bpe.PairTree(list(ranks))
    for _ in range(300):
        assert tree.find() == ranks.index(min(ranks))
        i = rng.randrange(33)
        ranks[i] = rng.randrange(9)
        tree.set(i, ranks[i])


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><script>x</script>
<h1>Head</h1><p>One<p>Two <b>bold</b> &amp; more<br>next<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
<table><tr><th>Name<th>N<tr><td>Al<td>1<tr><td>Barbara<td>22</table><div hidden>no</div><p style="display: none">no</p><!-- no --><pre>a
  b</pre>1 < 2</body></html>"""


def test_op8(spark, none):
    expect = "Head\n\nOne\n\nTwo bold & more\nnext\n\n- a\n- b\n  3. x\n  4. y\n\nName     N\nAl       1\nBarbara  22\n\na\n  b\n\n1 < 2"
    assert html_text.page_text(PAGE) == expect
    ship(spark)
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (3, "v", "", ""), (4, "w", "<div>" * 5000 + "deep", "")], "page_id bigint, url string, html string, text string")
    assert [r.text for r in html_text.extracted(pages).orderBy("page_id").collect()] == [expect, None, "", "deep"]
    assert html_text.extracted(pages.limit(0)).count() == 0
    for broken in ("<", "<p", "</", "<!--", "<a href='x", "<script>", "<table><td>x<tr>y", "</p></li>", "<ul>" * 200 + "x"):
        html_text.page_text(broken)


def test_op8_shows_formulas_drawn_text_open_dialogs_and_fallbacks():
    page = """<p>Let <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding="t">no</annotation></semantics></math> be.</p>
<p>See<svg><title>no</title><defs><text>no</text></defs>no<path d="M0"/><g><text x="1">Ax<tspan>is</tspan></text><rect/><text>Top</text></g>
<foreignObject><b>in it</b></foreignObject></svg>end</p><svg/><p>On</p>
<dialog>no</dialog><dialog open>Shown</dialog><dialog id=d>no</dialog><object data="f"><param name=a>Instead <b>of it</b></object>"""
    assert html_text.page_text(page) == "Let x=1 be.\n\nSee Axis Top in itend\n\nOn\n\nShown\nInstead of it"


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds.values(), 1) for m in re.finditer(p, t) if ok(m[0])]
    return sorted(found)


def test_op9(spark, docs, none):
    assert pii.personal_data(none).count() == 0 and pii.redacted(none).count() == 0
    rng = random.Random(9)
    bits = ["a@b.c", "x.y@z-1.org", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (2) 345-67890", "+", "12", " ", ".", "-", "_", "é", "no", "\n", "10.0.0.1.5.6.7.8", "a@b.c_d@e.f"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)] + ["9" * 3000, "a" * 3000 + "@", "a@" + "b." * 3000 + "c", "+1" + " 1" * 3000]
    noisy = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for rows, df in ((list(enumerate(texts)), noisy), ([(r[0], r[1]) for r in corpus()], docs)):
        got = Counter((r.doc_id, tuple((x.s, x.k, x.e) for x in r.base)) for r in pii.personal_data(df).collect())
        assert got == Counter((i, tuple(base(t or ""))) for i, t in rows)
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == len(corpus())
    clean = [r.text for r in out.collect() if r.text and "[EMAIL]" in r.text]
    assert clean and all("a.b@c.de" not in t and "10.0.0.255" not in t for t in clean)


def test_contexts_find_unseen_identifiers(spark):
    ship(spark)
    rng = random.Random(10)

    def card(valid):
        d = [rng.randrange(10) for _ in range(15)]
        s = "".join(map(str, d))
        last = next(str(x) for x in range(10) if luhn(s + str(x)))
        return s + (last if valid else str((int(last) + 3) % 10))

    rows = [(i, f"please charge account {card(i % 10 > 0)} today or see page {i} of 1234567 items") for i in range(200)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in got:
        i, t = rows[r.doc_id]
        at = t.index("account ") + 8
        assert (at, 3, at + 16) in [(x.s, x.k, x.e) for x in r.spans]
        assert len(r.spans) == 1 and (len(r.base) == 1) == (i % 10 > 0)


def test_identifiers_of_several_tokens_are_found_whole(spark):
    ship(spark)
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choices("123456789", k=n))
    rows, at = [], {}
    for i in range(120):
        seed = i % 10 > 0
        # The seed pattern runs on from a phone to an address behind it; quads that aren't seeds have an octet over 255.
        phone = f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"
        quad = f"10.0.{i % 10}.{i % 7 + 1}" if seed else f"10.0.0.{300 + i // 10}"
        text = f"ring {phone}{',' if seed else ' 190.137.223.204'} or ping {quad} ({i} of {digits(2)} 3rd)"
        rows.append((i, text))
        at[i] = [(5, 4, 5 + len(phone)), (text.index("ping ") + 5, 2, text.index("ping ") + 5 + len(quad))]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, _ in rows:
        spans = [(x.s, x.k, x.e) for x in found[i].spans]
        assert at[i][0] in spans and at[i][1] in spans and len(found[i].base) == (2 if i % 10 else 1)
    found = re.compile(re.sub(r"\\x22", '"', pii.TOKEN)).findall("tel +1 (826) 555-4081. 4111 1111 1111 1111, 10.0.0.1; 12 345abc 555-4081 3rd a@b.c 2020. 12 1234567 89 +1 (2) 3 10.1.2.3")
    assert found == ["+1 (826) 555-4081", "4111 1111 1111 1111", "10.0.0.1", "12", "345abc", "555-4081", "3rd", "a@b.c", "2020", "12 1234567", "89", "+1 (2) 3", "10.1.2.3"]


def test_op10(docs, none):
    assert linededup.without_repeated_runs(none).count() == 0
    for run in (1, 2, 3):
        rows = sorted(set(corpus()), key=lambda r: (r[0] is None, r[0] or 0))
        seen, gone = {}, {}
        for k, r in enumerate(rows):
            lines = [(i, x.strip(" \t\r\x0b\f").lower()) for i, x in enumerate((r[1] or "").split("\n"))]
            lines = [x for x in lines if x[1]]
            gone[r[0]] = set()
            for j in range(len(lines) - run + 1):
                w = lines[j : j + run]
                if seen.setdefault(tuple(x for _, x in w), (k, j)) != (k, j):
                    gone[r[0]] |= {i for i, _ in w}
        out = linededup.without_repeated_runs(docs, run=run)
        assert out.columns == [*docs.columns, "n_lines", "n_removed_lines"]
        got = out.collect()
        assert len(got) == len(corpus())
        for r in got:
            t = next(x[1] for x in rows if x[0] == r.doc_id)
            if t is None:
                assert r.text is None and r.n_lines == 0
            else:
                assert r.text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[r.doc_id])
                assert (r.n_lines, r.n_removed_lines) == (t.count("\n") + 1, len(gone[r.doc_id]))


def test_long_lines_and_short_documents_are_runs(spark):
    ship(spark)
    word = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    long, under, short = word(1, 50), word(2, 49), "a short line"
    texts = [
        f"{word(3, 5)}\n{long}\n{word(4, 5)}\n{short}\n{under}",
        f"{word(5, 5)}\n  {long.upper()} \n{word(6, 5)}",  # a long line in other surroundings
        f"{word(7, 5)}\n{under}\n{short}\n{word(8, 5)}",  # no long line, no run of two
        short,  # a document of one line that stood earlier
        f"\n{word(9, 5)}\n ",
        f"{word(9, 5)}",
        f"{word(10, 5)}\n{word(11, 5)}\n{word(9, 5)}",  # a short line of a longer document stays
        word(12, 5),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expect = list(texts)
    expect[1], expect[3], expect[5] = f"{word(5, 5)}\n{word(6, 5)}", "", ""
    assert [r.text for r in linededup.without_repeated_runs(docs, long_words=50).orderBy("doc_id").collect()] == expect
    assert [r.text for r in linededup.without_repeated_runs(docs).orderBy("doc_id").collect()] == texts
    # Only white space is trimmed.
    ends = spark.createDataFrame([(0, "the roof\nbox 10"), (1, "the roo\nox 1"), (2, "\x0bthe roof\x0c\n box 10\t")], "doc_id bigint, text string")
    assert [r.n_removed_lines for r in linededup.without_repeated_runs(ends).orderBy("doc_id").collect()] == [0, 0, 2]
    # In runs of three a document of two lines is one as a whole.
    pair = spark.createDataFrame([(0, "q\na\nb\nz"), (1, "a\nb"), (2, "b\na"), (3, "y\na\nb\nq")], "doc_id bigint, text string")
    assert [r.n_removed_lines for r in linededup.without_repeated_runs(pair, run=3, long_words=50).orderBy("doc_id").collect()] == [0, 2, 0, 0]
    import corpus_pipeline

    assert corpus_pipeline.line_stage(spark, docs.selectExpr("*", "'en' lang", "'s' source"), "").count() == len(texts) - 2


def test_chunk_ids_are_the_tokenizers():
    """Words, letters beyond Latin, marks, special tokens, odd separators and long chunks; small memories and new ones."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(9)
    odd = ["don't", "x.'s", "''s", "I'LL", "<|endoftext|>", "a<|startoftext|>b", "</w>", "İx", "ŉa", "ſt", "½a1b", "éa", "Σας", "ΟΔΟΣ", "a\xadb", "中文", "ab" * 90, "é" * 70, "a\x1cb", "..,'"]
    texts = ["", "  a b　c\x85d\xa0 ", "\x1f"] + [" ".join(rng.choice(VOCAB + odd) + rng.choice(["", ".", "'s", "Q"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    for most in (10, 10_000):
        encode = packing.ChunkIds(tokenizer_path(), most)
        for i in range(0, len(texts), 40):
            part = pa.array(texts[i : i + 40])
            for got, ids in zip(encode(part), want[i : i + 40], strict=True):
                assert got == b"".join(x.to_bytes(4, "little") for x in ids)
