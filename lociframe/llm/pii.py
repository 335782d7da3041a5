"""Personal data by bootstrapped contextual extraction, with DataFrame and SQL functions only.

Seeds are what four patterns find, and values that stand behind a word for a secret. Every run of digits or
token that looks like an identifier is an instance; its lexical patterns are the words around it with its
shape, or two words before it with its class alone. Over the graph of patterns and distinct instances, scores go
back and forth: a pattern is as good as its instances, an instance as good as its patterns. Patterns of
high confidence then yield the identifiers that no seed pattern matches; secrets come by patterns alone.

The seed patterns are written so that matching takes linear time whatever the text: they start only
where a run of their characters starts (or the last match ended), and runs are possessive. Places come from
sums in blocks, so that a text takes time in proportion to its matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, materialise, spread_join, text_hash, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: What the method finds besides the kinds of the base.
SECRET = len(KINDS) + 1
NAMES = (*KINDS, "secret")
#: What stands right before a value that seeds secrets, in lower case, and what such a value looks like.
KEYWORD = r"(?:token|secret|passw(?:or)?d|passphrase|credentials?|bearer|(?:api|access|private|auth)[_ -]?key)[a-z0-9_-]{0,20}[\x22\x27]? ?[=:]+ ?[\x22\x27]?$"
VALUE = r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])[a-z0-9+/_=.~-]{16,}$"
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts without a match of this have none of the pattern's.
NEEDS = {"email": "contains(t, '@')", "ip": "t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9][ -]?[0-9]'", "phone": "t rlike '[+][0-9]'"}
_END = r"(?=[).,;:!?\x22\x27\]}>-]*+(?![^ \t-\r]))"
_QUAD = rf"\(*+[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9]){_END}"
_RUN = rf"[+(]*+[0-9]++(?:(?:[.-]|\)?+(?:-|(?<![0-9]{{7}})[ ](?!{_QUAD}))?+\(?+)[0-9]{{1,8}}+(?![^ \t-\r.,;:!?\x22\x27()\[\]{{}}<>-]))*+{_END}"
#: Identifier-like runs, from a token's start: dotted quads; digits over several tokens, with brackets, hyphens,
#: dots and single spaces (not after seven digits: such a number stands alone); or a token with a digit or an at sign.
TOKEN = rf"(?<![^ \t-\r])(?:{_QUAD}|{_RUN}|(?=[^ \t-\r0-9@]*+[0-9@])[^ \t-\r]++)"
#: Rounds of scoring; confidence and number of distinct seeds that a pattern needs; digits that an instance needs,
#: unless it is a dotted quad or has an at sign.
ROUNDS, LEAST_CONFIDENCE, LEAST_SEEDS, LEAST_DIGITS = 3, 0.8, 5, 7


#: Matches whose lengths are summed one by one; the places of whole blocks are carried on.
BLOCK = 64
#: Code points of the text on either side that a match's context is read from: a pattern's definition.
CONTEXT = 64


def _placed(matches: str, gaps: str) -> str:
    """SQL for array<struct<s, e, v, g, a>>: each match's place in code points, from the lengths of the gaps between; g, a: the text before and after."""
    sizes = f"zip_with(slice({gaps}, 1, size({matches})), {matches}, (g, m) -> named_struct('g', length(g), 'n', length(g) + length(m)))"
    total = f"aggregate(slice(l, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x.n)"
    blocks = f"aggregate(transform(sequence(0, (size(l) - 1) div {BLOCK}), b -> {total}), array(0), (a, x) -> array_append(a, a[size(a) - 1] + x))"
    start = f"z.b[i div {BLOCK}] + aggregate(slice(z.l, i - i % {BLOCK} + 1, i % {BLOCK}), 0, (a, x) -> a + x.n) + z.l[i].g"
    place = let("s", start, f"named_struct('s', s, 'e', s + z.l[i].n - z.l[i].g, 'v', v, 'g', right(z.t[i], {CONTEXT}), 'a', left(z.t[i + 1], {CONTEXT}))")
    return let("l", sizes, let("z", f"named_struct('l', l, 'b', {blocks}, 't', {gaps})", f"transform({matches}, (v, i) -> {place})"))


def _luhn(digits: str) -> str:
    value = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + case when i % 2 = 0 then {value} when {value} > 4 then 2 * {value} - 9 else 2 * {value} end) % 10 = 0"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 and cast(right(p, 3) as int) <= 255)",
    "card": f"length({_DIGITS}) between 14 and 19 and {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) between 10 and 15",
}


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, t, email, ip, card, phone): for each kind array<struct<s, e>>, places in code points."""
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), text_or_empty(text).alias("t"))
    none = "cast(array() as array<string>)"
    for kind in KINDS:
        out = out.withColumn(f"m_{kind}", F.expr(f"case when {NEEDS[kind]} then regexp_extract_all(t, r'{PATTERNS[kind]}', 0) else {none} end"))
    for kind in KINDS:
        out = out.withColumn(f"g_{kind}", F.expr(f"case when size(m_{kind}) > 0 then split(t, r'{PATTERNS[kind]}', -1) else {none} end"))
    cols = ["doc_id", "key", "t"]
    for kind in KINDS:
        found = _placed(f"m_{kind}", f"g_{kind}")
        cols.append(f"case when size(m_{kind}) > 0 then transform(filter({found}, x -> {VALID[kind]}), x -> named_struct('s', x.s, 'e', x.e)) else cast(array() as array<struct<s:int,e:int>>) end as {kind}")
    return out.selectExpr(*cols)


_ARRAY = "array(" + ", ".join(f"'{n}'" for n in NAMES) + ")"


def _printed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(element_at({_ARRAY}, x.k), ':', cast(x.s as string), ':', cast(x.e as string))), ',')"


def _instances(placed: str) -> str:
    """SQL for array<struct<s, e, v, l1, l2, r, secret>>: the identifier-like ones of the placed tokens, with their contexts.

    A token with letters or an at sign is taken without a name and sign of assignment and quotes before it, which
    belong to its context, and without the punctuation behind it.
    """
    bare = r"regexp_extract(x.v, '^(?:[A-Za-z_][A-Za-z_-]*[=:]+)?[\\x22\\x27`<({,;\\[]*', 0)"
    tail = r"regexp_extract(x.v, '[\\x22\\x27`>)},;:!?.%$#*&\\]]*$', 0)"
    letters = "x.v rlike '[A-Za-z@]'"
    cut = f"transform({placed}, x -> named_struct('x', x, 'b', case when {letters} then {bare} else '' end, 'n', case when {letters} then length({tail}) else 0 end))"
    core = "substring(y.x.v, length(y.b) + 1, greatest(length(y.x.v) - length(y.b) - y.n, 0))"
    named = f"transform({cut}, y -> named_struct('s', y.x.s + length(y.b), 'e', greatest(y.x.e - y.n, y.x.s + length(y.b)), 'v', lower({core}), 'g', right(lower(concat(y.x.g, y.b)), {CONTEXT}), 'a', lower(y.x.a)))"
    wanted = f"length(regexp_replace(x.v, '[^0-9]', '')) >= {LEAST_DIGITS} or contains(x.v, '@') or x.v rlike '^[(]*[0-9]+([.][0-9]+){{3}}$' or x.v rlike r'{VALUE}'"
    words = r"regexp_replace(x.g, '[\\x22\\x27`]+$', '')"
    return f"""transform(filter({named}, x -> x.e > x.s and ({wanted})), x -> named_struct('s', x.s, 'e', x.e, 'v', x.v,
        'l1', regexp_extract({words}, r'([^ \t-\r]*)[ \t-\r]*$', 1), 'l2', regexp_extract({words}, r'([^ \t-\r]+[ \t-\r]+[^ \t-\r]+)[ \t-\r]*$', 1),
        'r', regexp_extract(x.a, r'^[^ \t-\r]*[ \t-\r]+([^ \t-\r]+)', 1), 'secret', x.v rlike r'{VALUE}' and x.g rlike r'{KEYWORD}'))"""


def _kinds(rows: DataFrame) -> DataFrame:
    """The instances of rows, one by one, with the kind k of a base span that overlaps: the last before or the first after its start."""
    some = rows.where("size(tokens) > 0")
    both = some.select("doc_id", "key", F.explode("tokens").alias("x"), F.lit(None).cast("int").alias("b")).select("doc_id", "key", "x.*", "b")
    spans = some.select("doc_id", "key", F.explode("base").alias("x")).select("doc_id", "key", "x.s", "x.e", F.col("x.k").alias("b"))
    both = both.unionByName(spans, allowMissingColumns=True)
    # Running frames in either direction; what starts at the same place counts for both.
    up, down = (Window.partitionBy("doc_id", "key").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in ("s", F.desc("s")))
    base = F.col("b").isNotNull()
    both = both.withColumn("last", F.max(F.when(base, F.struct("e", "b"))).over(up)).withColumn("next", F.min(F.when(base, F.struct("s", "b"))).over(down))
    k = F.when(F.col("last.e") > F.col("s"), F.col("last.b")).when(F.col("next.s") < F.col("e"), F.col("next.b")).when(F.col("secret"), SECRET)
    return both.where(~base).withColumn("k", k).drop("b", "last", "next", "secret")


def _patterns(seen: DataFrame) -> DataFrame:
    """(doc_id, key, s, e, i, p, k): an instance with each of its patterns.

    Shape: runs of letters and digits collapsed, and how many digits, in steps of four; of letters mixed with digits
    just that, and the length in steps of eight. Class: digits, mixed, or with an at sign.
    """
    kind = F.expr("case when contains(v, '@') then 'at' when v rlike '[a-z]' then 'mixed' else 'digits' end")
    mixed = "concat(regexp_replace(v, '[a-z0-9]+', 'x'), '/', length(v) div 8)"
    plain = "concat(regexp_replace(regexp_replace(v, '[a-z]+', 'a'), '[0-9]+', '9'), '/', length(regexp_replace(v, '[^0-9]', '')) div 4)"
    seen = seen.withColumn("class", kind).withColumn("shape", F.expr(f"case when class = 'mixed' then {mixed} else {plain} end"))
    # A run of several tokens has its shape alone as a pattern too: that says more than a single token's.
    p = "array(concat('1 ', l1, ' ', shape), if(contains(v, ' '), concat('0 ', shape), null), if(l2 <> '', concat('2 ', l2, ' ', class), null), if(r <> '' and l1 <> '', concat('3 ', l1, ' ', class, ' ', r), null))"
    return seen.selectExpr("doc_id", "key", "s", "e", "xxhash64(v) as i", f"explode(array_distinct(filter({p}, w -> w is not null))) as p", "k")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, n_email, n_ip, n_card, n_phone, base, spans) for each row of docs.

    base and spans: array<struct<s, k, e>> by start, then kind (1 email, 2 ip, 3 card, 4 phone, and in spans
    5 secret); the counts are of base. Null and empty texts have none; repeated rows have the same, of ties in a
    pattern's kind the least. The texts are read once; what goes on from there are places, tokens and scores.
    """
    rows = base_spans(docs, text)
    parts = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(KINDS, 1))
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({parts}))"))
    none = "cast(array() as array<string>)"
    rows = rows.withColumn("m", F.expr(f"case when t rlike '[0-9@]' then regexp_extract_all(t, r'{TOKEN}', 0) else {none} end"))
    rows = rows.withColumn("gaps", F.expr(f"case when size(m) > 0 then split(t, r'{TOKEN}', -1) else {none} end"))
    tokens = _instances(_placed("m", "gaps"))
    rows = rows.selectExpr("doc_id", "key", *[f"cast(size({k}) as bigint) as n_{k}" for k in KINDS], "base", f"case when size(m) > 0 then {tokens} else null end as tokens")
    rows = materialise(rows, "seeds")
    seen = materialise(_patterns(_kinds(rows)), "tokens")
    edges = materialise(seen.groupBy("p", "i").agg(F.max("k").alias("k"), F.count("*").alias("rows")), "graph")
    score = edges.groupBy("i").agg(F.max(F.col("k").isNotNull().cast("double")).alias("score"), F.count("*").alias("n"))
    pattern = None
    for _ in range(ROUNDS):
        score = materialise(score, "scores")
        scored = spread_join(edges, score, ["i"], ["p"])
        pattern = scored.groupBy("p").agg((F.sum("score") / (F.count("*") + 1)).alias("conf"), F.count("k").alias("seeds"), F.mode("k", True).alias("kind"), F.count("*").alias("n"), F.sum("rows").alias("rows"))
        pattern = materialise(pattern, "patterns")
        rated = spread_join(edges.drop("rows"), pattern.select("p", "conf", "n"), ["p"], ["i"])
        score = rated.groupBy("i").agg(F.greatest(F.max(F.col("k").isNotNull().cast("double")), 1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"), F.count("*").alias("n"))
    good = materialise(pattern.where((F.col("conf") >= LEAST_CONFIDENCE) & (F.col("seeds") >= LEAST_SEEDS)).select("p", "kind", F.col("rows").alias("n")), "good")
    open_ = seen.where(f"k is null or k = {SECRET}")
    more = spread_join(open_, good, ["p"], ["doc_id", "key", "s"]).groupBy("doc_id", "key", "s", "e").agg(F.min("kind").alias("k"))
    more = more.groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "k", "e")).alias("more"))
    m = more.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    out = rows.join(m, rows.doc_id.eqNullSafe(m._d) & (rows.key == m._k), "left")
    return out.select("doc_id", "key", *[f"n_{k}" for k in KINDS], "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def printed_spans(found: DataFrame) -> DataFrame:
    """The digest of personal_data: base_sha256 and the spans as kind:start:end, comma-joined."""
    return found.selectExpr("doc_id", *[f"n_{k}" for k in KINDS], f"sha2({_printed('base')}, 256) as base_sha256", f"{_printed('spans')} as spans")


#: Code points of a piece of text that is cut at once.
PIECE = 1024


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one, by the first's kind.

    Null and empty texts stay as they are; equal rows get equal texts. All other columns stay, whatever their names.
    """
    d, k, m, t, z = fresh(docs, "_d", "_k", "_m", "_t", "_z")
    span = personal_data(docs, text).where("size(spans) > 0").select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])
    span = span.select("doc_id", "key", F.explode("spans").alias("x")).select("doc_id", "key", "x.*")
    order = Window.partitionBy("doc_id", "key").orderBy("s", "k", "e")
    until = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    span = span.withColumn("opens", F.coalesce(F.col("s") >= until, F.lit(True)).cast("int")).withColumn("at", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = span.groupBy("doc_id", "key", "at").agg(F.min(F.struct("s", "k")).alias("f"), F.max("e").alias("e"))
    merged = merged.withColumn("p", F.coalesce(F.lag("e").over(Window.partitionBy("doc_id", "key").orderBy("at")), F.lit(0)))
    merged = merged.groupBy(F.col("doc_id").alias(d), F.col("key").alias(k)).agg(F.array_sort(F.collect_list(F.struct(F.col("f.s").alias("s"), F.col("f.k").alias("k"), "e", "p"))).alias(m))
    joined = docs.join(merged, docs["doc_id"].cast("bigint").eqNullSafe(merged[d]) & (text_hash(text) == merged[k]), "left")

    def between(p: str, s: str) -> str:
        part = f"substring({z}[j], greatest({p} - j * {PIECE}, 0) + 1, least({s} - j * {PIECE}, {PIECE}) - greatest({p} - j * {PIECE}, 0))"
        return f"case when {p} >= {s} then '' else array_join(transform(sequence(int({p} div {PIECE}), int(({s} - 1) div {PIECE})), j -> {part}), '') end"

    cut = f"array_join(transform(`{m}`, x -> concat({between('x.p', 'x.s')}, '[', upper(element_at({_ARRAY}, x.k)), ']')), '')"
    new = let(z, f"regexp_extract_all(`{text}`, '(?s).{{1,{PIECE}}}', 0)", f"concat({cut}, {between(f'element_at(`{m}`, -1).e', f'length(`{text}`)')})")
    return joined.select([F.expr(f"case when `{m}` is null then `{text}` else {new} end").alias(c) if c == text else docs[c] for c in docs.columns])
