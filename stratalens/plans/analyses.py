"""The analyses: each a plan over files, lines, symbols and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens import constants as K
from stratalens.functions import text
from stratalens.functions.paths import any_of, basename, contains_any
from stratalens.operators import graph, index


def _findings(lines: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """One row per line and rule that holds: rules are (test, struct)."""
    return lines.withColumn("found", F.filter(F.array(*[F.when(t, s) for t, s in rules]), lambda x: x.isNotNull())).select("*", F.explode("found").alias("hit")).drop("found")


def _secret_name(line: Column) -> tuple[Column, Column]:
    sep = F.when(line.contains("="), "=").when(line.contains(":"), ":")
    at = F.when(sep == "=", F.locate("=", line)).otherwise(F.locate(":", line))
    return F.btrim(line.substr(F.lit(1), at - 1), F.lit(" \t\"'")), F.btrim(line.substr(at + 1, F.length(line)), F.lit(" \t\r\"',;"))


def env_secret_severity(line: Column) -> Column:
    """critical, high or null for an assignment of a secret."""
    t = F.btrim(line, F.lit(" \t\r"))
    name, value = _secret_name(t)
    low, lv = F.lower(name), F.lower(value)
    ok = (t != "") & ~t.startswith("#") & ~t.startswith("//") & t.rlike("[=:]") & F.octet_length(name).between(1, 64) & (F.octet_length(value) >= 8)
    ok = ok & ~any_of([value.startswith(x) for x in ("${", "$(", "<", "{")]) & ~value.contains("(") & ~contains_any(lv, K.SECRET_NOT)
    return F.when(ok & contains_any(low, K.SECRET_CRITICAL), "critical").when(ok & (contains_any(low, K.SECRET_HIGH) | name.endswith("_TOKEN") | name.endswith("_KEY")), "high")


def security(files: DataFrame) -> DataFrame:
    skip = contains_any(F.col("path"), K.SECURITY_SKIP) | basename(F.col("path")).startswith("test")
    lines = index.lines(files.where(~skip))
    line = F.col("line")
    hit = lambda rule, sev: F.struct(F.lit(rule).alias("rule"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"))
    rules = [((F.lower(line) if ci else line).contains(t.lower() if ci else t), hit(rule, sev)) for t, rule, sev, ci in K.SECURITY]
    sev = env_secret_severity(line)
    rules += [(sev.isNotNull(), hit("hardcoded_secret_assignment", sev)), (line.rlike("AKIA[A-Z0-9]{16}"), hit("aws_access_key", "critical"))]
    return _findings(lines, rules).select(F.col("path").alias("file"), F.col("line_no").alias("line"), "hit.rule", "hit.severity", text.captured(line).alias("line_text"))


def dead_code(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols whose name is a word of no other file."""
    s = symbols.where(~F.col("kind").isin(K.DEAD_SKIP_KINDS) & (F.octet_length("name") > 2) & ~F.col("name").isin(K.DEAD_SKIP_NAMES))
    p = index.word_postings(files).groupBy("word").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"))
    out = s.join(p, F.col("name") == F.col("word"), "left")
    elsewhere = (F.coalesce("lo", "file_id") != F.col("file_id")) | (F.coalesce("hi", "file_id") != F.col("file_id"))
    return out.where(~elsewhere).select("name", "kind", F.col("path").alias("file"), F.col("line_start").alias("line"), F.lit("no references in other files").alias("reason"))


def unwrap_audit(files: DataFrame, symbols: DataFrame) -> DataFrame:
    line = F.col("line")
    marked = F.max(contains_any(line, K.TEST_MARKS).cast("int")).over(W.partitionBy("file_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)) == 1
    lines = index.lines(files.where("language = 'rust'")).withColumn("in_test", marked)
    t = F.ltrim(line, F.lit(" \t"))
    lines = lines.where(~t.startswith("//") & ~t.startswith("/*"))
    found = _findings(lines, [(line.contains(p), F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"))) for p, k in K.PANICS])
    path = F.col("path")
    severity = F.when(path.contains("test") | F.col("in_test") | path.endswith("main.rs"), "info").when(path.contains("gateway") | path.contains("api"), "critical").otherwise("medium")
    s = symbols.select(F.col("file_id").alias("sf"), "name", "line_start", "line_end", "ord")
    j = found.join(s, (F.col("file_id") == F.col("sf")) & F.col("line_no").between(F.col("line_start"), F.col("line_end")), "left")
    keys = ["path", "line_no", "hit", "in_test", "line"]
    return j.groupBy(*keys).agg(F.min_by("name", "ord").alias("scope")).select(path.alias("file"), F.col("line_no").alias("line"), "hit.kind", severity.alias("severity"), text.captured(line).alias("line_text"), "scope")


def test_coverage(symbols: DataFrame) -> DataFrame:
    test_file = F.col("path").contains("test")
    names = symbols.where(test_file).select(F.col("name").alias("tested")).distinct()
    s = symbols.where(~test_file).join(names, F.col("name") == F.col("tested"), "left")
    is_test = F.col("kind") == "test"
    out = s.groupBy(F.col("path").alias("file")).agg(
        F.count("*").alias("symbols"), F.count_if(~is_test & ~F.col("name").startswith("_")).alias("public"), F.count_if(is_test).alias("tests"), F.count_if(~is_test & F.col("tested").isNotNull()).alias("referenced"))
    level = F.when((F.col("tests") > 0) & (F.col("referenced") > F.expr("public div 2")), "High").when((F.col("tests") > 0) | (F.col("referenced") > 0), "Medium").otherwise("None")
    return out.withColumn("coverage", level)


def _layer(path: Column) -> tuple[Column, Column]:
    rank, name = None, None
    for k, (n, words) in enumerate(K.LAYERS):
        hit = contains_any(path, words)
        rank = F.when(hit, k) if rank is None else rank.when(hit, k)
        name = F.when(hit, n) if name is None else name.when(hit, n)
    return rank, name


def architecture(files: DataFrame, edges: DataFrame) -> DataFrame:
    rank, name = _layer(F.col("path"))
    f = files.select("file_id", F.col("path").alias("p"), rank.alias("rank"), name.alias("layer")).where("rank IS NOT NULL")
    a = f.withColumnsRenamed({"file_id": "src", "p": "from", "rank": "ra", "layer": "from_layer"})
    b = f.withColumnsRenamed({"file_id": "dst", "p": "to", "rank": "rb", "layer": "to_layer"})
    return edges.join(a, "src").join(b, "dst").where("ra > rb").select("from", "to", "from_layer", "to_layer")


def _routes(lines: DataFrame, patterns: list[str], quotes: str) -> DataFrame:
    def one(p: str) -> tuple[Column, Column]:
        after = F.col("line").substr(F.locate(p, F.col("line")) + len(p), F.length("line"))
        path = F.regexp_extract(after, rf"^[{quotes}]?([^{quotes}]+)[{quotes}]", 1)
        method = next((m for m in ("get", "post", "put", "delete", "patch") if m in p.lower()), "UNKNOWN")
        return F.col("line").contains(p) & (path != ""), F.struct(path.alias("url"), F.lit(method.upper()).alias("method"))

    return _findings(lines, [one(p) for p in patterns]).select("path", "line_no", "hit.url", "hit.method")


def crossref(files: DataFrame) -> DataFrame:
    """kind (wired, backend_only, frontend_only), route, url: routes joined with calls by the ends of the calls' paths."""
    lines = index.lines(files)
    back = _routes(lines.where(F.col("language").isin("rust", "go", "python")), K.ROUTE_PATTERNS, '"`').select(F.col("url").alias("route")).distinct()
    front = _routes(lines.where(F.col("language").isin("typescript", "javascript")), K.CALL_PATTERNS, "\"`'").select("url").distinct()
    plain = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"\?.*$", "")
    front = front.withColumn("plain", plain)
    ends = front.select("url", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("plain"), F.lit(1))), lambda i: F.substring("plain", i, F.length("plain")))).alias("route"))
    wired = ends.join(back, "route").select(F.lit("wired").alias("kind"), "route", "url").distinct()
    b = back.join(wired, "route", "left_anti").select(F.lit("backend_only").alias("kind"), "route", F.lit(None).cast("string").alias("url"))
    f = front.join(wired, "url", "left_anti").select(F.lit("frontend_only").alias("kind"), F.lit(None).cast("string").alias("route"), "url")
    return wired.unionByName(b).unionByName(f)


def type_fields(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Fields of types: type, language, path, ord, field, field_type."""
    s = symbols.where(F.col("kind").isin("struct", "class", "interface") & F.col("language").isin("rust", "typescript", "go", "python"))
    lines = index.lines(files.join(s, "file_id", "left_semi")).select(F.col("file_id").alias("lf"), "line_no", "line")
    j = s.join(lines, (F.col("file_id") == F.col("lf")) & (F.col("line_no") > F.col("line_start")) & (F.col("line_no") < F.col("line_end") + F.when(F.col("language") == "python", 1).otherwise(0)))
    t = F.btrim("line", F.lit(" \t\r"))
    skip = (t == "") | t.rlike(r"^(//|#|/\*|\*|pub fn|fn |func |def |async |impl|@|\{|\})")
    colon = F.locate(":", t)
    left = F.when(colon > 0, t.substr(F.lit(1), colon - 1))
    right = F.when(colon > 0, t.substr(colon + 1, F.length(t)))
    left = F.regexp_replace(left, r"^(pub\(crate\) |pub |readonly |private |public |protected )+", "")
    lang, words = F.col("language"), F.split(t, r"\s+")
    is_go = lang == "go"
    name = F.when(is_go, F.when((F.size(words) >= 2) & ~F.element_at(words, 1).isin("type", "func", "var", "const"), F.element_at(words, 1))).otherwise(F.when(~left.contains("("), F.btrim(left, F.lit(" \t?"))))
    kind = F.when(is_go, F.try_element_at(words, F.lit(2))).when(lang == "python", F.btrim(F.regexp_replace(right, r"=.*$", ""), F.lit(" \t,;"))).otherwise(F.btrim(right, F.lit(" \t,;")))
    out = j.where(~skip).select(F.col("name").alias("type"), "language", "path", "file_id", F.col("line_start").alias("at"), F.col("line_no"), name.alias("field"), kind.alias("field_type"))
    return out.where(F.col("field").isNotNull() & (F.col("field") != "") & (F.octet_length("field") <= 64))


def _compatible(a: Column, b: Column) -> Column:
    return (a == b) | any_of([(a.startswith(x) & b.startswith(y)) | (a.startswith(y) & b.startswith(x)) for x, y in K.TYPE_PAIRS])


def type_drift(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """issue (mismatch, missing), type, field, from_path, to_path, from_type, to_type for types of one name in two languages."""
    f = type_fields(files, symbols)
    first = f.groupBy("type", "language", "path", "file_id", "at", "field").agg(F.min_by("field_type", "line_no").alias("field_type"))
    owner = first.select("type", "language", "path", "file_id", "at").distinct()
    b_owner = owner.withColumnsRenamed({"language": "bl", "path": "to_path", "file_id": "bf", "at": "bat"})
    earlier = (F.col("file_id") < F.col("bf")) | ((F.col("file_id") == F.col("bf")) & (F.col("at") < F.col("bat")))
    pairs = owner.join(b_owner, "type").where((F.col("language") != F.col("bl")) & earlier)
    a = pairs.join(first.select("file_id", "at", "field", F.col("field_type").alias("from_type")), ["file_id", "at"])
    b = first.select(F.col("file_id").alias("bf"), F.col("at").alias("bat"), "field", F.col("field_type").alias("to_type"))
    j = a.join(b, ["bf", "bat", "field"], "left")
    issue = F.when(F.col("to_type").isNull(), "missing").when(~_compatible(F.col("from_type"), F.col("to_type")), "mismatch")
    return j.withColumn("issue", issue).where("issue IS NOT NULL").select("issue", "type", "field", F.col("path").alias("from_path"), "to_path", "from_type", "to_type")


def _table_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, "[_-]", "")), "s$", "")


def db_schema(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """issue (orphan_migration, missing_migration), table, file."""
    lines = index.lines(files)
    mig = lines.where(F.col("path").contains("migration") | F.col("path").endswith(".sql"))
    table = F.regexp_extract("line", r"(?i)^\s*(?:create table (?:if not exists )?|create_table )([^ (\r\n]+)", 1)
    made = mig.select(table.alias("table"), F.col("path").alias("file")).where("table <> ''").distinct()
    hint = lines.where(contains_any(F.col("line"), K.ORM_HINTS)).select(F.col("file_id").alias("hf"), F.col("line_no").alias("hl"))
    own = symbols.where(F.col("kind").isin("struct", "class")).join(hint, (F.col("file_id") == F.col("hf")) & (F.col("line_start") <= F.col("hl") + 3) & (F.col("line_end") >= F.col("hl")), "left_semi")
    code = own.select(F.col("name").alias("table"), F.col("path").alias("file")).distinct()
    a, b = made.withColumn("k", _table_key(F.col("table"))), code.withColumn("k", _table_key(F.col("table")))
    orphan = a.join(b.select("k"), "k", "left_anti").select(F.lit("orphan_migration").alias("issue"), "table", "file")
    return orphan.unionByName(b.join(a.select("k"), "k", "left_anti").select(F.lit("missing_migration").alias("issue"), "table", "file"))


def migration_parity(files: DataFrame) -> DataFrame:
    """issue (duplicate, gap), sequence, previous, file. Only names meet in one window, as the sequence is one."""
    p = F.col("path")
    number = F.regexp_extract(basename(p), r"^[vV]?(\d+)", 1).try_cast("bigint")
    m = files.where(p.contains("migration") & p.rlike(r"\.(sql|rs|py|ts)$")).select(p.alias("file"), number.alias("sequence")).where("sequence > 0")
    m = m.withColumn("previous", F.lag("sequence").over(W.orderBy("sequence", "file")))
    issue = F.when(F.col("sequence") == F.col("previous"), "duplicate").when(F.col("sequence") > F.col("previous") + 1, "gap")
    return m.withColumn("issue", issue).where("issue IS NOT NULL").select("issue", "sequence", "previous", "file")


def manifests(files: DataFrame) -> DataFrame:
    """file, violation, detail."""
    base = basename(F.col("path"))
    m = files.withColumn("base", base).where(base.isin("Cargo.toml", "package.json", "go.mod"))
    low, line = F.lower("line"), F.col("line")
    lines = index.lines(m).where(line.contains('"') & line.rlike("[=:]") & ~line.contains("[dependencies]") & ~line.contains('"dependencies"'))
    cred = _findings(lines, [(low.contains(w), F.struct(F.lit(w).alias("word"))) for w in K.CREDENTIAL_WORDS]).select(F.col("path").alias("file"), F.lit("credential").alias("violation"), F.concat_ws(":", F.col("line_no").cast("string"), F.col("hit.word")).alias("detail"))
    content = F.col("content")
    need = F.when(F.col("base") == "Cargo.toml", F.filter(F.array(*[F.lit(x) for x in ("name", "version", "edition")]), lambda x: ~F.contains(content, x)))
    need = need.when(F.col("base") == "package.json", F.filter(F.array(F.lit("name"), F.lit("version")), lambda x: F.coalesce(F.substring(content, F.greatest(F.position(x, content) - 1, F.lit(1)), F.lit(1)) != '"', F.lit(True))))
    missing = m.select(F.col("path").alias("file"), F.lit("missing_field").alias("violation"), F.explode(need).alias("detail"))
    return cred.unionByName(missing)


_URL_END = r"""[^ \t"'`)\]>,]*"""


def literals(files: DataFrame) -> DataFrame:
    """file, line, category, value: at most one of each kind per line."""
    path, line = F.col("path"), F.col("line")
    f = files.where(~contains_any(path, K.LITERAL_SKIP) & ~F.col("language").isin(K.LITERAL_SKIP_LANGUAGES))
    lines = index.lines(f).where((line != "") & (F.octet_length("line") <= 2000))
    t = F.ltrim(line, F.lit(" \t"))
    comment = t.startswith("//") | t.startswith("/*") | t.startswith("*") | (t.startswith("#") & F.col("language").isin("python", "bash", "toml", "yaml"))
    # each costly test only where a plain one doesn't rule it out, and once: the columns are used more than once below
    first = [F.regexp_extract("line", rf"(?:^|[^A-Za-z0-9_-])({s}://{_URL_END})", 1) for s in K.SCHEMES]
    url = F.when(line.contains("://"), F.coalesce(*[F.when(line.contains(f"{s}://"), F.nullif(x, F.lit(""))) for s, x in zip(K.SCHEMES, first)]))
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0?[0-9]?[0-9])"
    ip = F.when(line.rlike(r"\d\.\d{1,3}\.\d"), F.regexp_extract("line", rf"(?:^|[^A-Za-z0-9.])({octet}\.{octet}\.{octet}\.{octet})(?:$|[^A-Za-z0-9.])", 1)).otherwise("")
    bodies = F.concat(F.regexp_extract_all("line", F.lit(r'"([A-Za-z0-9_+/=-]{24,})"'), F.lit(1)), F.regexp_extract_all("line", F.lit(r"'([A-Za-z0-9_+/=-]{24,})'"), F.lit(1)))
    secret = F.when((line.contains('"') | line.contains("'")) & (F.octet_length("line") >= 26), F.try_element_at(F.filter(bodies, lambda b: (F.length(b) >= 40) | (b.rlike("[A-Z].*[A-Z]") & b.rlike("[0-9].*[0-9]"))), F.lit(1)))
    abs_path, port = None, None
    for x in K.ABS_PATHS:
        abs_path = F.when(line.contains(x), x) if abs_path is None else abs_path.when(line.contains(x), x)
    for x in K.MAGIC_PORTS:
        port = F.when(line.contains(":" + x), ":" + x) if port is None else port.when(line.contains(":" + x), ":" + x)
    todo = F.when(contains_any(line, ["TODO", "FIXME", "XXX", "HACK", "BUG:"]), F.regexp_extract("line", r"(?:^|[^A-Za-z0-9_])(TODO|FIXME|XXX|HACK|BUG:)", 1)).otherwise("")
    lines = lines.select("path", "line_no", "line", comment.alias("comment"), url.alias("url"), ip.alias("ip"), secret.alias("secret"), todo.alias("todo"))
    comment, url, ip, secret, todo = (F.col(c) for c in ("comment", "url", "ip", "secret", "todo"))
    local = lambda v: v.contains("localhost") | v.contains("127.0.0.1") | v.contains("0.0.0.0")
    s = lambda category, v: F.struct(category.alias("category"), v.alias("value"))
    rules = [
        (~comment & url.isNotNull(), s(F.when(local(url), "localhost").otherwise("url"), url)),
        (~comment & (ip != ""), s(F.when(ip.startswith("127.") | (ip == "0.0.0.0"), "localhost").otherwise("ip"), ip)),
        (~comment & secret.isNotNull(), s(F.lit("secret_suspect"), secret)), (~comment & abs_path.isNotNull(), s(F.lit("abs_path"), abs_path)),
        (~comment & port.isNotNull() & url.isNull(), s(F.lit("magic_port"), port)), (todo != "", s(F.lit("todo"), todo)),
    ]
    return _findings(lines, rules).select(path.alias("file"), F.col("line_no").alias("line"), "hit.category", "hit.value")


def smallest(rows: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """keys, first: the n smallest values, sorted. Rows beyond them go before they meet, so no group is held whole."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(column))
    kept = rows.withColumn("rank", rank).where(F.col("rank") <= n)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias("first"))


def duplication(symbols: DataFrame) -> DataFrame:
    """name, kind, count, files: names defined in two files and more."""
    s = symbols.where(F.col("kind").isin(K.DUPLICATE_KINDS) & ~F.col("language").isin(K.DUPLICATE_SKIP_LANGUAGES) & (F.octet_length("name") > 3) & ~F.col("name").isin(K.DUPLICATE_SKIP_NAMES))
    per = s.groupBy("name", "path").agg(F.min_by("kind", "ord").alias("kind"))
    g = per.groupBy("name").agg(F.count("*").alias("count"), F.min_by("kind", "path").alias("kind"))
    first = smallest(per.select("name", "path"), ["name"], "path", 8)
    return g.where("count >= 2").join(first, "name").select("name", "kind", "count", F.array_join("first", ",").alias("files"))


def clones(files: DataFrame, symbols: DataFrame, least: int = K.CLONE_LINES) -> DataFrame:
    """lines, count, functions: functions whose bodies are alike but for indentation and comments."""
    s = symbols.where(F.col("kind").isin("function", "method") & (F.col("line_end") > F.col("line_start") + least)).select("file_id", "path", "name", "ord", "line_start", "line_end")
    parts = F.slice(F.split("content", "\n"), F.col("line_start") + 1, F.col("line_end") - F.col("line_start"))
    tidy = F.transform(parts, lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\r")), "[ \t]+", " "))
    kept = F.filter(tidy, lambda x: (x != "") & ~any_of([x.startswith(c) for c in K.CLONE_COMMENT]))
    body = files.select(F.col("file_id"), "content").join(s, "file_id").withColumn("kept", kept).where(F.size("kept") >= least)
    body = body.select(F.sha2(F.array_join("kept", "\n"), 256).alias("body"), F.size("kept").alias("size"), F.concat_ws(":", "path", "name").alias("who"))
    g = body.groupBy("body").agg(F.count("*").alias("count"), F.min("size").alias("lines")).where("count >= 2")
    return g.join(smallest(body.select("body", "who"), ["body"], "who", 8), "body").select("lines", "count", F.array_join("first", ",").alias("functions"))


def complexity(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", "language", (F.regexp_count("content", F.lit(K.CONTROL_FLOW)) + 1).alias("complexity"))


def hotspots(files: DataFrame, churn: DataFrame) -> DataFrame:
    """file, churn, complexity, score; generated files, churn 0 and complexity 2 or less left out. churn: path, churn."""
    c = complexity(files.where(~contains_any(F.col("path"), K.GENERATED))).where("complexity > 2").join(churn.where("churn > 0"), "path")
    return c.select(F.col("path").alias("file"), "churn", "complexity", (F.col("churn") * F.col("complexity")).alias("score"))


def suggestions(hot: DataFrame, god: DataFrame, findings: DataFrame, copied: DataFrame) -> DataFrame:
    """Advice for each hotspot. god, copied: file; findings: file, n."""
    j = hot.join(god.select("file").distinct().withColumn("g", F.lit(True)), "file", "left").join(findings, "file", "left").join(copied.select("file").distinct().withColumn("c", F.lit(True)), "file", "left")
    busy = F.col("churn") >= 20
    says = F.concat_ws(" ", F.when(F.col("g"), "Many files depend on it and it depends on many: split it."), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" security finding(s): fix them."))),
                       F.when(F.col("c"), "Holds copied blocks: share one helper."), F.when(busy & (F.col("complexity") >= 40), "Changes often and is complex: test, then split.").when(busy, "Changes often: keep it well tested."))
    return j.select("file", "churn", "complexity", "score", F.when(says == "", "Changes meet complexity: review it.").otherwise(says).alias("suggestion"))


def action_plan(sec: DataFrame, clone: DataFrame, dup: DataFrame, coupled: DataFrame, cycles: DataFrame, hot: DataFrame, dead: DataFrame, limit: int = 50) -> DataFrame:
    """priority, category, title, n: what to do first."""
    row = lambda df, p, cat, title, n: df.select(p.cast("int").alias("priority"), F.lit(cat).alias("category"), title.alias("title"), n.cast("long").alias("n"))
    rank = F.min(F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).otherwise(3))
    s = sec.groupBy("rule").agg(rank.alias("p"), F.count("*").alias("n"))
    c = clone.where("count >= 3 OR lines >= 12")
    first = lambda df, *order, k=5: df.orderBy(*order).limit(k)
    parts = [
        row(s, F.col("p"), "security", F.col("rule"), F.col("n")), row(c, F.when(F.col("lines") * F.col("count") >= 150, 2).otherwise(3), "duplication", F.col("functions"), F.col("count")),
        row(first(dup, F.desc("count"), "name", k=12).where("count >= 5"), F.lit(3), "reuse", F.col("name"), F.col("count")), row(first(coupled.where("role = 'god'"), F.desc(F.col("fan_in") + F.col("fan_out")), "path"), F.lit(3), "modularity", F.col("path"), F.col("fan_out")),
        row(first(cycles, F.desc("size"), "component"), F.lit(3), "architecture", F.concat(F.lit("cycle of "), F.col("component").cast("string")), F.col("size")), row(first(hot, F.desc("score"), "file"), F.lit(3), "stability", F.col("file"), F.col("score")),
        row(dead.agg(F.count("*").alias("n")).where("n > 0"), F.lit(4), "cleanup", F.lit("unreferenced symbols"), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("priority", "category", "title").limit(limit)


def health(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals."""
    sec = security(files)
    one = lambda df, name, c=None: df.agg((F.count("*") if c is None else c).alias(name))
    cyc = graph.components(edges)
    cl = clones(files, symbols)
    parts = [
        one(files, "files"), one(symbols, "symbols"), one(edges, "dependency_edges"), sec.agg(F.count_if(F.col("severity") == "critical").alias("security_critical"), F.count("*").alias("security_total")),
        one(unwrap_audit(files, symbols), "panic_sites"), one(cyc, "circular_deps", F.count_distinct("component")), one(graph.coupling(files.select(F.col("file_id").alias("node"), "path"), edges).where("role = 'god'"), "god_modules"),
        one(dead_code(files, symbols), "dead_symbols"), one(duplication(symbols), "duplicate_names"), cl.agg(F.count("*").alias("clone_groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("cloned_functions")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out


def plan_symbol(files: DataFrame, symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row: what a change of a symbol touches."""
    from stratalens.operators import search

    defs = symbols.where((F.col("name") == name) & ~F.col("kind").isin("import", "module"))
    callers = search.find_callers(files, symbols, name)
    primary = defs.orderBy("path", "ord").limit(1).select(F.col("file_id").alias("node"), F.col("path").alias("primary_file"))
    impact = graph.change_impact(edges, primary.select("node"))
    role = graph.coupling(files.select(F.col("file_id").alias("node"), "path"), edges).join(primary, "node").select("primary_file", "fan_in", "fan_out", "role")
    a = defs.agg(F.count("*").alias("definitions")).crossJoin(callers.agg(F.count("*").alias("callers_total"), F.count_distinct("path").alias("caller_files")))
    b = impact.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("transitive"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return a.crossJoin(b).join(role, F.lit(True), "left")


def literal_counts(files: DataFrame) -> DataFrame:
    """file, urls, localhosts, magic_ports, abs_paths, todos: in how many lines of the file each kind occurs."""
    line, t = F.col("line"), F.btrim("line", F.lit(" \t\r"))
    lines = index.lines(files).where((t != "") & (F.octet_length("line") <= 2000))
    url, local = contains_any(line, ["http://", "https://"]), contains_any(line, ["localhost", "127.0.0.1", "0.0.0.0"])
    kinds = {"urls": url & ~local, "localhosts": url & local, "magic_ports": contains_any(line, [f":{p}" for p in K.PLAN_PORTS]), "abs_paths": contains_any(line, K.PLAN_PATHS), "todos": contains_any(t, ["TODO", "FIXME", "XXX"])}
    found = lines.groupBy("path").agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
    return files.select("path").join(found, "path", "left").select(F.col("path").alias("file"), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in kinds])


def plan_file(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """One row: what a change of a file touches, and the literals in it."""
    from stratalens.operators import search

    f = search.resolve_path(files, path)
    node = f.select(F.col("file_id").alias("node"))
    impact = graph.change_impact(edges, node)
    role = graph.coupling(files.select(F.col("file_id").alias("node"), "path"), edges).join(node, "node", "left_semi").select(F.col("path").alias("file"), "fan_in", "fan_out", "role")
    defs = symbols.join(f.select("file_id"), "file_id", "left_semi").agg(F.count("*").alias("definitions"))
    reach = impact.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("transitive"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return role.join(literal_counts(f), "file").crossJoin(defs).crossJoin(reach)  # single rows


def plan_change(files: DataFrame, symbols: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """The plan for a file if the target is a path of one, else for a symbol."""
    if files.where((F.col("path") == target) | F.col("path").endswith("/" + target)).limit(1).count():
        return plan_file(files, symbols, edges, target)
    return plan_symbol(files, symbols, edges, target)


def caller_groups(callers: DataFrame, samples: int = 3) -> DataFrame:
    """Callers by file, most first, with their first lines."""
    first = smallest(callers.select("path", "line_no"), ["path"], "line_no", samples)
    return callers.groupBy("path").agg(F.count("*").alias("count")).join(first, "path").select("path", "count", F.col("first").alias("lines")).orderBy(F.desc("count"), "path")


ANALYSES = {f.__name__: f for f in (security, dead_code, unwrap_audit, test_coverage, architecture, crossref, type_drift, db_schema, migration_parity, manifests, literals, duplication, clones, complexity, health)}
ANALYSES["coupling"] = lambda files, edges: graph.coupling(files.select(F.col("file_id").alias("node"), "path"), edges)
ANALYSES["cycles"] = lambda files, edges: graph.cycle_groups(edges, files)
ANALYSES["literal_scan"] = literals



def analyze(name: str, **tables: DataFrame) -> DataFrame:
    """Runs an analysis by name on those of files, symbols and edges that it takes."""
    import inspect

    if name not in ANALYSES:
        raise ValueError(f"no such analysis: {name}")

    f = ANALYSES[name]
    return f(**{k: v for k, v in tables.items() if k in inspect.signature(f).parameters})
