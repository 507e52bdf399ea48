"""Secret scans by multipart credential linking, in DataFrame operations only.

Strong patterns (``assign``, ``access``, ``hex``) are reported wherever they stand. Weak candidates are parts of a
credential that mean nothing alone: identifiers (named ones, and e-mail addresses as logins), mixed tokens and short
assigned values as secrets, endpoints (URLs, hosts by address). They are reported only if a complementary part lies within
``scope`` code points in the same text - a secret beside an identifier or an endpoint, and the reverse - and if no strong
span overlaps them. An interval join finds these: every part covers the position buckets of its scope, a candidate stands
in its own buckets, and equal buckets plus an overlap test decide. A bucket holds as many parts as fit into its width, so
the join grows with the texts. Both sides are shuffled, never broadcast. All-digit ``hex`` spans are reported, but are no
evidence of a secret.

Positions: Spark has no function for them, so a text is split by the pattern, and the lengths of the pieces and of the
matches are summed up by a window per text. A pattern that needs a word or a character is tried only on texts that have it.

Defined results: null text is empty; an empty text has no spans; a match may be as long as the text; repeated rows each
give a row; a null doc_id stays null; further columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actispark.llm.common import broadcast_if_small, documents, forget, fresh, materialise, text_key

#: The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak candidates. Where a plain pattern would start again at every character of a long word, (?<!) and ++ keep it linear.
IDENT = r"""(?i:user(?:name)?|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}|(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}"""
LOGIN = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
MIXED = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D"'<>]+"""
HOST = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}(?::[0-9]++)?"
#: Of these, a mixed token has all three, and a hex span that is evidence of a secret has a letter.
THREE = ("[0-9]", "[a-z]", "[A-Z]")

#: kind -> (order, pattern, role, strong)
KINDS = {
    "assign": (0, ASSIGN, "secret", True),
    "access": (1, ACCESS, "identifier", True),
    "hex": (2, HEX, "secret", True),
    "identifier": (3, IDENT, "identifier", False),
    "login": (4, LOGIN, "identifier", False),
    "mixed": (5, MIXED, "secret", False),
    "endpoint": (6, ENDPOINT, "endpoint", False),
    "host": (7, HOST, "endpoint", False),
    "short_assign": (8, None, "secret", False),
}
STRONG = [k for k, v in KINDS.items() if v[3]]
#: What a text must contain for a pattern to be tried: any of these in the lower-case text, or as they are, or a pattern.
_LOWER = {"assign": ("passw", "secret", "token", "api"), "identifier": ("user", "login", "account", "client", "key", "asia", "aida", "aroa", "agpa", "anpa")}
_PLAIN = {"access": ("AKIA",), "login": ("@",), "endpoint": ("://",)}
_FIRST = {"hex": HEX, "mixed": MIXED, "host": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"}
SCOPE = 256


def _pieces(text: Column, low: Column, kind: str) -> Column:
    """Per match of the kind, in order: the length of the text before it since the last match, its length, and value: the
    length of what is assigned, or whether the match is what its kind wants."""
    pattern = KINDS[kind][1]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "assign":
        value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length)
    elif kind == "mixed":
        value = F.transform(hits, lambda h: (h.rlike(THREE[0]) & h.rlike(THREE[1]) & h.rlike(THREE[2])).cast("int"))
    elif kind == "hex":
        value = F.transform(hits, lambda h: h.rlike(THREE[1]).cast("int"))
    else:
        value = F.transform(hits, lambda h: F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), F.transform(hits, F.length).alias("size"), value.alias("value")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")),
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,value:int>>")
    if kind in _FIRST:
        may = text.rlike(_FIRST[kind])
    else:
        may = reduce(lambda a, b: a | b, [(low if kind in _LOWER else text).contains(w) for w in (_LOWER | _PLAIN)[kind]])
    return F.when(may, rows).otherwise(none)


def _buckets(df: DataFrame, before: int, width: int) -> DataFrame:
    """Each row once for each bucket of [start - before, end + before]."""
    first, last = F.greatest(F.col("start") - before, F.lit(0)), F.col("end") + before
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))


def _linked(parts: DataFrame, scope: int, width: int = SCOPE) -> DataFrame:
    """text_id, kind, start, end of the weak parts(text_id, kind, start, end, role, evidence) that are to be reported."""
    strong = F.col("kind").isin(*STRONG)
    weak = _buckets(parts.where(~strong).select("text_id", "kind", "start", "end", "role"), 0, width)
    others = _buckets(parts.where(strong | F.col("evidence")), scope, width)
    p = others.select("text_id", "bucket", *[F.col(c).alias(f"p_{c}") for c in ("start", "end", "role", "evidence")], strong.alias("p_strong"))
    near = (F.col("start") < F.col("p_end") + scope) & (F.col("end") > F.col("p_start") - scope)
    covered = F.col("p_strong") & (F.col("start") < F.col("p_end")) & (F.col("end") > F.col("p_start"))
    fits = F.col("p_evidence") & F.when(F.col("role") == "secret", F.col("p_role") != "secret").otherwise(F.col("p_role") == "secret")
    met = weak.join(p.hint("merge"), ["text_id", "bucket"]).where(near & (covered | fits))
    found = met.groupBy("text_id", "kind", "start", "end").agg(F.bool_or(covered).alias("covered"), F.bool_or(fits).alias("fits"))
    return found.where(F.col("fits") & ~F.col("covered")).drop("fits", "covered")


def find_spans(texts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """text_id, kind, start, end, base of all reported spans of texts(text_id, hits): hits as ``hits_of`` gives them."""
    w = Window.partitionBy("text_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        texts.where(F.size("hits") > 0)
        .select("text_id", F.inline("hits"))
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w))
        .withColumn("start", F.col("end") - F.col("size"))
    )
    short = (F.col("kind") == "assign") & (F.col("value") < 12)
    found = found.where(~short | (F.col("value") >= 6)).where((F.col("kind") != "mixed") | (F.col("value") > 0))
    kind = F.when(short, "short_assign").otherwise(F.col("kind"))
    role = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[2])]), F.col("kind"))
    found = found.select("text_id", kind.alias("kind"), "start", "end", (F.col("value") > 0).alias("evidence")).withColumn("role", role)
    parts = materialise(found, "secret-parts")
    base = parts.where(F.col("kind").isin(STRONG)).select("text_id", "kind", "start", "end")
    return base.withColumn("base", F.lit(True)).unionByName(_linked(parts, scope).withColumn("base", F.lit(False)))


def hits_of(text: Column, low: Column) -> Column:
    """All matches in text; low is the text in lower case."""
    return F.concat(*[_pieces(text, low, k) for k in KINDS if KINDS[k][1]])


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans."""
    texts = materialise(
        docs.select(F.monotonically_increasing_id().alias("text_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("low", F.lower("text")).select("text_id", "doc_id", hits_of(F.col("text"), F.col("low")).alias("hits")), "secret-hits",
    )
    order = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])]), F.col("kind"))
    per_text = (
        find_spans(texts, scope)
        .groupBy("text_id")
        .agg(F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "end", "kind", "base"))).alias("all"))
    )
    spans = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,o:int,end:bigint,kind:string,base:boolean>>"))
    base = F.filter(spans, lambda s: s["base"])
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return texts.select("text_id", "doc_id").join(per_text.hint("merge"), "text_id", "left").select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.size(F.filter(spans, lambda s: ~s["base"])).cast("long").alias("n_linked"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"),
    )


def redact_secrets(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text replaced by mark and n_chars renewed where it exists. Other rows stay as they
    are. Spans depend on the text alone, so equal texts are scanned for once and looked up by a 96-bit key of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*text_key(), text.alias("text")).withColumn("low", F.lower("text"))
    hits = keyed.select("text_hash", "text_crc", hits_of(F.col("text"), F.col("low")).alias("hits")).where(F.size("hits") > 0)
    texts = materialise(hits.groupBy("text_hash", "text_crc").agg(F.first("hits").alias("hits")).withColumn("text_id", F.monotonically_increasing_id()), "secret-hits")
    # Spans that overlap become one: a new one starts where a start lies beyond all ends before it.
    before = F.max("end").over(Window.partitionBy("text_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        find_spans(texts, scope)
        .withColumn("before", before)
        .withColumn("new", (F.col("before").isNull() | (F.col("start") > F.col("before"))).cast("int"))
        .withColumn("island", F.sum("new").over(Window.partitionBy("text_id").orderBy("start", "end")))
        .groupBy("text_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    )
    hash_, crc, cuts, new = fresh(docs, "text_hash", "text_crc", "cut", "new")
    found = materialise(islands.join(texts.select("text_id", "text_hash", "text_crc"), "text_id").select("text_hash", "text_crc", "cut").toDF(hash_, crc, cuts), "secret-cuts")
    forget(texts)
    held = found.agg(F.count("*") + F.coalesce(F.sum(F.size(cuts)), F.lit(0))).first()[0]  # rows and what their lists hold
    h, c = text_key()
    joined = docs.join(broadcast_if_small(found, held, 200_000), (h == F.col(hash_)) & (c == F.col(crc)), "left")
    text, cut = F.col("text"), F.col(cuts)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda s: s["end"]))
    starts = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: F.substring(text, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    # The new text has a name of its own: beside an alias "text", lambdas would read that one.
    joined = joined.withColumn(new, F.when(cut.isNull(), text).otherwise(F.array_join(kept, mark)))
    out = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut.isNull(), F.col("n_chars")).otherwise(F.char_length(new).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[out.get(x, F.col(f"`{x}`")).alias(x) for x in docs.columns])


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def _sql() -> str:
    """The same in DuckDB: its patterns know no look-behind and need none, since they never start a word again."""
    plain = {k: v[1] for k, v in KINDS.items() if v[1]} | {"login": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "host": r"[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?"}
    q = lambda p: "'" + p.replace("'", "''") + "'"
    value = {"assign": f"list_transform(regexp_extract_all(text, {q(ASSIGN)}, 2), lambda h: length(h))", "mixed": "list_transform(h, lambda x: CAST(regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AS BIGINT))"}
    value["hex"] = "list_transform(h, lambda x: CAST(regexp_matches(x, '[a-z]') AS BIGINT))"
    each = " UNION ALL ".join(
        f"SELECT id, '{k}' AS kind, unnest(range(1, len(h) + 1)) AS i, unnest(g[1 : len(h)]) AS gap, unnest(list_transform(h, lambda x: length(x))) AS size, unnest({value.get(k, 'list_transform(h, lambda x: CAST(1 AS BIGINT))')}) AS value FROM"
        f" (SELECT id, text, regexp_extract_all(text, {q(p)}) AS h, list_transform(string_split_regex(text, {q(p)}), lambda x: length(x)) AS g FROM d) WHERE len(h) > 0"
        for k, p in plain.items()
    )
    roles = ", ".join(f"('{k}', {o}, '{r}', {s})" for k, (o, _, r, s) in KINDS.items())
    n = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in STRONG)
    one = "kind || ':' || a || ':' || z"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents), hits AS ({each}),
placed AS (SELECT id, kind, value, CAST(sum(gap + size) OVER w - size AS BIGINT) AS a, CAST(sum(gap + size) OVER w AS BIGINT) AS z FROM hits WINDOW w AS (PARTITION BY id, kind ORDER BY i)),
named AS (SELECT id, CASE WHEN kind = 'assign' AND value < 12 THEN 'short_assign' ELSE kind END AS kind, a, z, value > 0 AS evidence FROM placed WHERE (kind <> 'assign' OR value >= 6) AND (kind <> 'mixed' OR value > 0)),
parts AS (SELECT named.*, o, role, strong FROM named JOIN (VALUES {roles}) r(kind, o, role, strong) USING (kind)),
weak AS (SELECT c.id, c.kind, c.a, c.z, c.o FROM parts c JOIN parts p ON c.id = p.id AND NOT c.strong AND c.a < p.z + {SCOPE} AND c.z > p.a - {SCOPE} GROUP BY ALL
 HAVING bool_or(p.evidence AND CASE WHEN c.role = 'secret' THEN p.role <> 'secret' ELSE p.role = 'secret' END) AND NOT bool_or(p.strong AND c.a < p.z AND c.z > p.a)),
spans AS (SELECT id, kind, a, z, o, true AS base FROM parts WHERE strong UNION ALL SELECT id, kind, a, z, o, false FROM weak),
listed AS (SELECT id, {n}, count(*) FILTER (NOT base) AS n_linked, coalesce(string_agg({one}, ',' ORDER BY a, o, z) FILTER (base), '') AS b, string_agg({one}, ',' ORDER BY a, o, z) AS spans FROM spans GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in STRONG)}, coalesce(n_linked, 0) AS n_linked, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (id)"""


SQL = _sql()
