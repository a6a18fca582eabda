"""The tools: point lookups and searches over files, lines, symbols and postings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens import constants as K
from stratalens.functions import paths, text
from stratalens.operators import index


def status(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Counts and the estimate of tokens saved by outlines."""
    n = symbols.agg(F.count("*").alias("symbols"))
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total_bytes"))
    out = f.crossJoin(n).withColumn("naive_tokens", F.expr("total_bytes div 4")).withColumn("outline_tokens", F.col("symbols") * 10)
    return out.withColumn("savings_pct", F.expr("CASE WHEN outline_tokens < naive_tokens THEN (naive_tokens - outline_tokens) * 100 div naive_tokens ELSE 0L END"))


def beside(files: DataFrame, found: DataFrame, most_bytes: int | None) -> DataFrame:
    """The files found in an index, and those too long for it (over most_bytes), which are read directly."""
    if most_bytes is None:
        return files.join(found, "file_id", "left_semi")
    return files.where(F.col("byte_size") <= most_bytes).join(found, "file_id", "left_semi").unionByName(files.where(F.col("byte_size") > most_bytes))


def candidates(files: DataFrame, query: str, postings: DataFrame | None = None) -> DataFrame:
    """Files whose postings hold all trigrams of the query."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    if postings is None:  # without an index the same test is made on the texts, which costs less than making one
        held = [F.col("content").contains(g) for g in grams if "\n" not in g]
        return files.where(F.lit(len(held) == len(grams)) & ~paths.any_of([~h for h in held])).select("file_id")
    return index.of_terms(postings, grams).groupBy("file_id").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(grams)).select("file_id")


def scoped(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds the smallest symbol that contains the line: scope, scope_kind. Symbols join by file, ranges as residue."""
    s = symbols.select(F.col("file_id").alias("sf"), F.col("name").alias("scope"), F.col("kind").alias("scope_kind"), "line_start", "line_end", "ord")
    inside = (F.col("file_id") == F.col("sf")) & F.col("line_no").between(F.col("line_start"), F.col("line_end"))
    keys = hits.columns
    best = F.min_by(F.struct("scope", "scope_kind"), F.struct(F.col("line_end") - F.col("line_start"), F.col("ord")))
    return hits.join(s, inside, "left").groupBy(*keys).agg(best.alias("b")).select(*keys, "b.scope", "b.scope_kind")


def search(files: DataFrame, query: str, symbols: DataFrame | None = None, limit: int | None = 50, postings: DataFrame | None = None, most_bytes: int | None = None) -> DataFrame:
    """Lines that contain the query, by path and line; queries under three bytes find nothing. most_bytes: the postings'."""
    if len(query.encode()) < 3:
        return index.lines(files.limit(0)).select("path", "line_no", "line", F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("scope_kind"))
    if postings is None or len(query) < 3:  # the trigram test is implied by the verification; two characters have none
        found = files.where(F.col("content").contains(query))
    else:
        found = beside(files, candidates(files, query, postings), most_bytes).where(F.col("content").contains(query))
    hits = index.lines(found).where(F.col("line").contains(query)).select("file_id", "path", "line_no", "line")
    out = scoped(hits, symbols) if symbols is not None else hits.withColumn("scope", F.lit(None).cast("string")).withColumn("scope_kind", F.lit(None).cast("string"))
    out = out.drop("file_id")
    return out.orderBy("path", "line_no").limit(limit) if limit else out


def find_word(files: DataFrame, word: str, limit: int | None = 50, postings: DataFrame | None = None, most_bytes: int | None = None) -> DataFrame:
    if postings is None:
        found = files.where(F.col("content").contains(word))
    else:
        found = beside(files, index.of_terms(postings, [word]).select("file_id"), most_bytes)
    out = index.lines(found).where(F.array_contains(text.words(F.col("line")), word)).select("path", "line_no", "line")
    return out.orderBy("path", "line_no").limit(limit) if limit else out


def find_symbol(symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    return symbols.where(F.col("name").contains(name)).select("path", "line_start", "line_end", "kind", "name").orderBy("path", "line_start", "name").limit(limit)


def resolve_path(files: DataFrame, path: str) -> DataFrame:
    """The exact path, or the smallest path that ends in it after a slash."""
    exact = F.col("path") == path
    return files.where(exact | F.col("path").endswith("/" + path)).orderBy(~exact, "path").limit(1)


def outline(files: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    f = resolve_path(files, path).select("file_id", "path", "language", "line_count", "byte_size")
    s = symbols.select("file_id", "ord", "name", "kind", "line_start", "line_end")
    return f.join(s, "file_id", "left").drop("file_id").orderBy("ord")


def tree(files: DataFrame, symbols: DataFrame) -> DataFrame:
    n = symbols.groupBy("file_id").agg(F.count("*").alias("symbols"))
    return files.join(n, "file_id", "left").select(paths.basename(F.col("path")).alias("name"), "path", "language", F.col("line_count").alias("lines"), F.coalesce("symbols", F.lit(0).cast("long")).alias("symbols"))


def read_file(files: DataFrame, path: str, start: int = 1, end: int = 2**31 - 1) -> DataFrame:
    return index.lines(resolve_path(files, path)).where(F.col("line_no").between(start, end)).select("path", "line_no", "line").orderBy("line_no")


def read_symbol(files: DataFrame, symbols: DataFrame, name: str, path: str | None = None, context: int = 0) -> DataFrame:
    """The lines of the best match: an exact name first, then by path and order."""
    s = symbols.where(F.col("name").contains(name) & (F.col("path").contains(path) if path else F.lit(True)))
    best = s.orderBy(F.col("name") != name, "path", "ord").limit(1).select(F.col("file_id"), F.col("name").alias("symbol"), "line_start", "line_end")
    lines = index.lines(files.join(best, "file_id", "left_semi")).join(best, "file_id")
    return lines.where(F.col("line_no").between(F.col("line_start") - context, F.col("line_end") + context)).select("path", "symbol", "line_no", "line").orderBy("line_no")


USE_STARTS = ["use ", "pub use ", "pub(crate) use ", "export ", "import ", "from "]
REEXPORT_STARTS = ["pub use ", "pub(crate) use ", "export "]


def find_callers(files: DataFrame, symbols: DataFrame, name: str, limit: int | None = 100) -> DataFrame:
    """Lines that use a name outside its definitions, with what kind of use the first telling occurrence is."""
    # a file where the name is no word of its own has no line that passes the test of whole words below
    lines = index.lines(files.where(F.col("content").contains(name))).where(F.col("line").contains(name))
    own = symbols.where(F.col("name") == name).select(F.col("file_id").alias("df"), "line_start", "line_end")
    lines = lines.join(own, (F.col("file_id") == F.col("df")) & F.col("line_no").between(F.col("line_start"), F.col("line_end")), "left_anti")
    t = F.ltrim(F.col("line"), F.lit(" \t"))
    use = paths.any_of([t.startswith(s) for s in USE_STARTS]) | t.contains('from "') | t.contains("from '")
    again = paths.any_of([t.startswith(s) for s in REEXPORT_STARTS])
    # pieces between occurrences: an occurrence is seen with the end of the piece before and the start of the next
    pieces = F.split("line", re.escape(name), -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct(F.element_at(pieces, i).alias("a"), F.element_at(pieces, i + 1).alias("b"), i.alias("i")))
    # a neighbour across an empty piece is the name itself, a word character
    a = lambda o: F.when((o["a"] == "") & (o["i"] > 1), F.lit(name)).otherwise(o["a"])
    b = lambda o: F.when((o["b"] == "") & (o["i"] < F.size(pieces) - 1), F.lit(name)).otherwise(o["b"])
    whole = F.filter(ends, lambda o: ~a(o).rlike("[A-Za-z0-9_]$") & ~b(o).rlike("^[A-Za-z0-9_]"))
    kind = lambda o: (
        F.when(~F.col("use") & (a(o).endswith("::") | b(o).startswith("::")), "path")
        .when((a(o).endswith(".") | a(o).endswith("->")) & b(o).startswith("("), "method").when(b(o).startswith("("), "call")
        .when(F.col("again"), "reexport").when(F.col("use"), "import").otherwise("other")
    )
    kinds = F.filter(F.transform(whole, kind), lambda k: k != "other")
    out = lines.withColumn("use", use).withColumn("again", again).withColumn("context", F.try_element_at(kinds, F.lit(1))).where("context IS NOT NULL")
    out = out.select("path", "line_no", "context", F.btrim("line", F.lit(" \t\r")).alias("line"))
    return out.orderBy("path", "line_no").limit(limit) if limit else out


def hot_files(changes: DataFrame, limit: int = 20) -> DataFrame:
    """The last records, newest first, of a log of bounded length."""
    return changes.orderBy(F.desc("seq")).limit(min(limit, K.CHANGE_LOG))


def changes_since(changes: DataFrame, since: int) -> DataFrame:
    """Records after `since`, of the log's last; truncated if the log no longer reaches back so far."""
    kept = changes.orderBy(F.desc("seq")).limit(K.CHANGE_LOG)
    oldest = kept.agg(F.min("seq").alias("oldest"))
    return kept.where(F.col("seq") > since).crossJoin(F.broadcast(oldest)).select("seq", "path", "op", (F.lit(since > 0) & (F.lit(since) < F.col("oldest"))).alias("truncated"))
