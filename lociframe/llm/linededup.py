"""Removal of repeated runs of lines by winnowing over line hashes, with DataFrame functions only.

Of every RUN lines with words that follow each other the one of the least hash is selected, the rightmost of equal
ones, so any RUN lines that stand in two places have the same line selected in both. Selected lines are the
fingerprints: they meet by their hash, and those that stand once go no further. A match is then extended to both
sides, over the lines of the windows that selected it. Longer matches need no further steps, as all windows in
them have selected lines, whose extensions cover the windows. The lines of later matches are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialise, spread_join, text_hash, text_or_empty

#: Lines in a window: the shortest run that is surely found.
RUN = 2
#: Words of a line that is a run of its own in the pipeline.
LONG_WORDS = 50

_BLANK = r" \t\r\u000b\u000c"
_LINE = f"lower(trim(BOTH '{_BLANK}' FROM x))"


def _selected(size: str, own: str) -> str:
    """SQL for array<struct<selected, matches>>: the lines of l that windows of `size` lines select, and these windows."""
    least = "-array_min(transform(w, x -> named_struct('h', x.h, 'j', -x.j))).j"
    window = f"named_struct('p', {least}, 'around', xxhash64(w.h), 'lines', w.i, 'own', {own})"
    windows = f"transform(sequence(0, size(l) - {size}), s -> {let('w', f'slice(l, s + 1, {size})', window)})"
    # Windows that select the same line follow each other: the first of them speaks for all.
    first = f"case when s = 0 or ws[s - 1].p <> v.p then filter(slice(ws, s + 1, {size}), u -> u.p = v.p) end"
    return let("ws", windows, f"filter(transform(ws, (v, s) -> named_struct('selected', l[v.p].h, 'matches', {first})), z -> z.matches is not null)")


def selected_lines(docs: DataFrame, text: str = "text", run: int = RUN, long_words: int | None = None) -> DataFrame:
    """(doc_id, key, selected, matches): a row for each line that winnowing selects, with the windows that its match extends to.

    With long_words windows of fewer than `run` lines are winnowed too, as what long lines and short documents match.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), text_or_empty(text).alias("t"))
    long = "" if long_words is None else f", 'long', size(split({_LINE}, '[{_BLANK}]+')) >= {long_words}"
    line = f"named_struct('i', i, 'h', case when {_LINE} = '' then null else xxhash64({_LINE}) end{long})"
    rows = rows.selectExpr("doc_id", "key", f"filter(transform(split(t, '\\n'), (x, i) -> {line}), x -> x.h is not null) as l")
    rows = rows.where(f"size(l) >= {run if long_words is None else 1}")
    rows = rows.selectExpr("doc_id", "key", f"transform(l, (x, j) -> named_struct('i', x.i, 'h', x.h, 'j', j{'' if long_words is None else ', ' + repr('long') + ', x.long'})) as l")
    found = _selected(str(run), "true")
    if long_words is not None:
        found = f"flatten(transform(sequence(1, least({run}, size(l))), m -> {_selected('m', f'm = least({run}, size(l)) or (m = 1 and w[0].long)')}))"
    return rows.selectExpr("doc_id", "key", f"inline({found})")


def repeated_runs(docs: DataFrame, text: str = "text", run: int = RUN, long_words: int | None = None) -> DataFrame:
    """(doc_id, key, gone): the line numbers (from 0) that lie in runs found earlier; only rows with such lines.

    Lines are equal if they are so trimmed and in lower case; lines without words neither match nor break
    a run. Earlier: by doc_id (null last), then text hash, then line. Equal rows count as one place, so
    neither loses its lines to the other. Counts and first places merge before their shuffles; a line or pair
    that very many rows have is dealt to several tasks.

    With long_words a line of that many words is a run of its own, and so is a document of fewer than `run`
    lines as a whole: it goes if its lines stood together anywhere earlier. Other windows shorter than
    `run` are only what these are compared with.
    """
    line = materialise(selected_lines(docs, text, run, long_words), "selected")
    seen = materialise(line.groupBy("selected").agg(F.count("*").alias("n")).where("n > 1"), "seen")
    met = spread_join(line, seen, ["selected"], ["doc_id", "key"]).selectExpr("doc_id", "key", "selected", "inline(matches)")
    met = materialise(met, "matches")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", F.col("lines")[0].alias("at"))
    first = met.groupBy("selected", "around").agg(F.min(place).alias("first"), F.max(F.when(F.col("own"), place)).alias("last"), F.count("*").alias("n"))
    first = materialise(first.where("first < last").drop("last"), "first")
    later = spread_join(met.where("own"), first, ["selected", "around"], ["doc_id", "key"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))


def without_repeated_runs(docs: DataFrame, text: str = "text", run: int = RUN, long_words: int | None = None) -> DataFrame:
    """docs with the lines of later repeated runs deleted from the text, and n_lines and n_removed_lines.

    A null text stays null and has no lines; a text all of whose lines go is empty, its row stays. Columns
    n_lines and n_removed_lines that docs has are replaced; all its others, whatever their names, stay as they are.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    d, k, g, split = fresh(docs, "_d", "_k", "_g", "_l")
    gone = repeated_runs(docs, text, run, long_words).withColumnsRenamed({"doc_id": d, "key": k, "gone": g})
    out = docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone[d]) & (text_hash(text) == gone[k]), "left")
    # The lines that stay are looked up by number in one split of the text.
    kept = let(split, f"split(`{text}`, '\\n')", f"array_join(transform(array_except(sequence(0, size({split}) - 1), `{g}`), i -> {split}[i]), '\\n')")
    return out.select(
        *[F.expr(f"case when `{g}` is null then `{text}` else {kept} end").alias(c) if c == text else docs[c] for c in docs.columns],
        F.expr(f"cast(coalesce(size(split(`{text}`, '\\n')), 0) as bigint)").alias("n_lines"),
        F.expr(f"cast(coalesce(size(`{g}`), 0) as bigint)").alias("n_removed_lines"),
    )
