"""One query per corpus operator, over its whole table, and the SQL that checks it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RULES_SQL = """[
    {'rule': 'symbols', 'v': 1000 * n_symbols // greatest(word_chars, 1), 'rise': 40, 'low': false},
    {'rule': 'marks', 'v': 1000 * n_marks // greatest(word_chars, 1), 'rise': 80, 'low': false},
    {'rule': 'capitals', 'v': 1000 * n_capitals // greatest(word_chars, 1), 'rise': 150, 'low': false},
    {'rule': 'echoes', 'v': 1000 * n_echoes // greatest(n_words, 1), 'rise': 200, 'low': false},
    {'rule': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1), 'rise': 600, 'low': false},
    {'rule': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1), 'rise': 280, 'low': false},
    {'rule': 'long_words', 'v': 100 * word_chars // greatest(n_words, 1), 'rise': 300, 'low': false},
    {'rule': 'short_words', 'v': 100 * word_chars // greatest(n_words, 1), 'rise': 200, 'low': true}]"""


def _breaks_sql(name: str, keys: str) -> str:
    """CTE with the first rises of the merged sketches' quantiles per ``keys`` and rule."""
    by = f"{keys}, rule, rise" if keys else "rule, rise"
    return f"""{name}_c AS (SELECT {by}, bucket, sum(n) AS n, max(top) AS top FROM sketch GROUP BY {by}, bucket),
{name}_u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS BIGINT) AS upto,
  CAST(sum(n) OVER (PARTITION BY {by}) AS BIGINT) AS docs FROM {name}_c),
{name}_k AS (SELECT {by}, docs, top, unnest(range(CAST(200 * (upto - n) // docs AS BIGINT) + 1, 200 * upto // docs + 1)) AS step FROM {name}_u),
{name}_w AS (SELECT *, max(top) OVER (PARTITION BY {by} ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead,
  min(top) OVER (PARTITION BY {by} ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS behind FROM {name}_k),
{name} AS (SELECT {by}, max(docs) AS docs, min_by((top + ahead) / 2, step) FILTER (step >= 100 AND ahead - top > rise) AS high,
  max_by((top + behind) / 2, step) FILTER (step <= 100 AND top - behind > rise) AS low FROM {name}_w GROUP BY {by})"""


_OP1_SQL = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
x AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS c FROM x),
cov AS (SELECT doc_id, sum(least(8, coalesce(i - prev, 8))) AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echoes,
    len(regexp_extract_all(t, '[!-/:-@\[-`{{-~]')) AS n_marks, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
e AS (SELECT doc_id, lang, source, base_failed, unnest({_RULES_SQL}) AS r FROM b),
v AS (SELECT doc_id, lang, source, base_failed, r.rule AS rule, CAST(r.v AS BIGINT) AS v, r.rise AS rise, r.low AS low FROM e),
sketch AS (SELECT lang, source, rule, rise, count(*) AS n, max(v) AS top,
    CASE WHEN v < 64 THEN v ELSE 64 + (length(bin(v)) - 7) * 32 + (v >> CAST(length(bin(v)) - 6 AS BIGINT)) - 32 END AS bucket
  FROM v WHERE NOT base_failed GROUP BY ALL),
{_breaks_sql("own", "lang, source")},
{_breaks_sql("per", "lang")},
{_breaks_sql("every", "")},
q AS (SELECT own.lang, own.source, own.rule,
    CASE WHEN own.docs >= 200 THEN own.high WHEN per.docs >= 200 THEN per.high ELSE every.high END AS high,
    CASE WHEN own.docs >= 200 THEN own.low WHEN per.docs >= 200 THEN per.low ELSE every.low END AS low
  FROM own JOIN per ON own.lang IS NOT DISTINCT FROM per.lang AND own.rule = per.rule JOIN every ON own.rule = every.rule),
f AS (SELECT v.doc_id, string_agg(v.rule, ',' ORDER BY list_position(['symbols', 'marks', 'capitals', 'echoes', 'dup_lines',
    'repeats', 'long_words', 'short_words'], v.rule)) AS broken
  FROM v JOIN q ON v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source AND v.rule = q.rule
  WHERE NOT base_failed AND CASE WHEN v.low THEN v < q.low ELSE v > q.high END GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND broken IS NULL AS kept, coalesce(broken, '') AS broken FROM b LEFT JOIN f USING (doc_id)"""


@query(_OP1_SQL)
def op1_quality_rules(spark, sf_dir):
    """Base counts of every text, and the verdict of the adaptive limits."""
    from evenhand.llm import quality

    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.selectExpr(
        "_row.doc_id AS doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "array_join(broken, ',') AS broken",
    )


@query()
def op4_bpe(spark, sf_dir):
    """Ids of every text, and the text decoded from them, as digests."""
    import public_tokenizers

    from evenhand.llm import bpe

    docs = table(spark, sf_dir, "documents")
    coded = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"], digests=True)
    return coded.select("_row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query()
def op7_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    from pyspark.sql import functions as F

    from evenhand.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=3)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query()
def op3_pii(spark, sf_dir):
    """Base and added spans of personal data in every text."""
    from pyspark.sql import functions as F

    from evenhand.llm import pii

    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs), ["doc_id"])
    return found.select(
        "_row.doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


@query()
def op6_mixing(spark, sf_dir):
    """Words the mix takes of every document."""
    from evenhand.llm import mixing

    return mixing.report(table(spark, sf_dir, "documents"))


@query()
def op5_licenses(spark, sf_dir):
    """Base places and labels of every text, and the labels of the signature rules."""
    from evenhand.llm import licenses

    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("_row.doc_id", *[c for c in found.columns if c != "_row"])


@query()
def op10_url_filters(spark, sf_dir):
    """Rule and verdict of every page's url; a page is labelled as its document is."""
    from pyspark.sql import functions as F

    from evenhand.llm import urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marks = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("_doc"),
        ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"),
    )
    numbered = pages.select("page_id", urls.number(F.col("url")).alias("_doc"))
    return urls.judge(pages, numbered.join(marks, "_doc").select("page_id", "bad"))


@query()
def op8_sharding(spark, sf_dir):
    """Shard and slot of every document, at near equal bytes."""
    from pyspark.sql import functions as F

    from evenhand.llm import sharding

    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op2_winnowing(spark, sf_dir):
    """Fingerprints of every text and its edited text, and how alike they are."""
    from evenhand.llm import winnow

    return winnow.compare(table(spark, sf_dir, "documents"))


@query()
def op9_lm_scores(spark, sf_dir):
    """Base and model log probability of every text."""
    from evenhand.llm import lm

    return lm.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round spelled out: distances to all centroids, then exact floors of the means."""
    steps = [
        f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id,
    list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM
    (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT v.r, c,
    CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - w.x[i]) * (v.x[i] - w.x[i]))) AS BIGINT) AS d
  FROM v, c{n} AS w) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT best.c AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
  FROM a{n} JOIN v USING (r), range(1, 65) AS g(i) GROUP BY ALL),
m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} AS z ON z.c = best.c"""


@query(_op11_sql())
def op11_ptolemaic_clusters(spark, sf_dir):
    """Cluster of every vector after five rounds, with inertia and centroid."""
    from evenhand.llm import pivots

    return pivots.report(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


_OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * o >= 85 * (x.n_shingles + y.n_shingles - o)),
pairs AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT b, root FROM reach JOIN pairs ON a = doc_id)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(root) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY doc_id"""


@query(_OP12_SQL)
def op12_ngram_jaccard_join(spark, sf_dir):
    """Number of distinct 4-word shingles of every document, and its component of links."""
    from evenhand.llm import ngramjoin

    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


_OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(ws) < 100,
    'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails FROM m LEFT JOIN l USING (doc_id)),
p AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B
    WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS bad, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS x FROM orders, range(1, 6) AS r(step)),
-- the step at which each cell's documents go in each order
gone AS (SELECT p.*, filter_order, coalesce(list_min(list_transform(bad, lambda b: instr(filter_order, b))), 6) AS hit FROM p, orders),
each_ AS (SELECT part, filter_order, step, x, sum(CASE WHEN hit > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit < step AND list_contains(bad, x) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bad = [x] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM gone JOIN steps USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM each_"""


@query(_OP13_SQL)
def op13_filter_interaction(spark, sf_dir):
    """What every order of the five filters removes, step by step, in each language."""
    from evenhand.llm import interplay

    return interplay.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "lang")
