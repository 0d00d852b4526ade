"""Queries of the training-data operators and, where SQL can state the result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm import boosted_quality, context_tree, weak_toxicity
from hostweave.llm.alignment import aligned, piece_count, with_link_counts
from hostweave.llm.collocations import collocations
from hostweave.llm.decontaminate import overlaps
from hostweave.llm.fair_mix import mixed
from hostweave.llm.packing import packed
from hostweave.llm.parity_join import near_duplicates
from hostweave.llm.preferences import next_reply, preference_pairs
from hostweave.llm.quality_rules import fit_rules, judged
from hostweave.llm.substring_dedup import remove_repeats
from hostweave.llm.tag_paths import extracted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op9_substring_dedup",
    f"""
WITH d AS (SELECT doc_id, {SPLIT} AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+34], ' ')) AS k FROM s),
r AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT doc_id, count(g.j) AS n, string_agg(x, ' ' ORDER BY j) FILTER (WHERE g.j IS NULL) AS t FROM u LEFT JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words"), 256).alias("kept_sha256"))


@query(
    "op2_near_duplicates",
    rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS u, doc_id AS c FROM d UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(c) AS c FROM r GROUP BY u) c USING (doc_id)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_h")


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit_rules(docs))


@query(
    "op8_fair_mix",
    r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
r AS (SELECT source, s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * s / w, place) AS k FROM w),
l AS (SELECT *, CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT level FROM l WHERE CAST(3 * s AS DOUBLE) >= level * w ORDER BY k LIMIT 1),
t AS (SELECT source, s, place, least(CAST(3 * s AS DOUBLE), f.level * w) AS target FROM l, f),
q AS (SELECT d.*, t.s, t.place, t.target, sum(size) OVER (PARTITION BY t.place ORDER BY md5(CAST(doc_id AS VARCHAR)), size ROWS UNBOUNDED PRECEDING) AS cum
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, place, (CAST(e AS BIGINT) * s + cum) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, place ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT doc_id, sum(size) AS taken FROM g WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, size, CAST(s AS BIGINT) AS source_size, round(target, 6) AS target, CAST(coalesce(n.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN n USING (doc_id)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op3_boosted_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = boosted_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return boosted_quality.scored(docs, trees).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op4_weak_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = weak_toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return weak_toxicity.scored(docs, fitted).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op6_context_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(table(spark, sf_dir, "documents"))


@query("op7_tag_paths")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query(
    "op10_preference_pairs",
    r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, turn, role, text FROM conversations),
l AS (SELECT c, max(i) AS m FROM t GROUP BY c),
z AS (SELECT t.*, row_number() OVER (ORDER BY c) AS n, count(*) OVER () AS all_n FROM t JOIN l USING (c) WHERE i = m AND role = 'assistant'),
a AS (SELECT z.c, z.i, coalesce(y.text, '') AS text FROM z JOIN z y ON y.n = z.n % z.all_n + 1),
r AS (SELECT t.c, t.i, t.role, CASE WHEN t.i = a.i THEN a.text ELSE t.text END AS text FROM t JOIN a USING (c)),
q AS (SELECT t.c, min(CASE WHEN t.text <> r.text THEN t.i END) AS d, max(t.i) AS m FROM t JOIN r ON t.c = r.c AND t.i = r.i GROUP BY t.c),
k AS (SELECT c, coalesce(d - 1, m) AS n FROM q),
b AS (SELECT c, i, 'c' AS side, role, text FROM t UNION ALL SELECT c, i, 'r', role, text FROM r),
f AS (SELECT b.c, i, CASE WHEN i <= k.n THEN 'p' ELSE side END AS part, role, '<|' || role || '|>' || chr(10) AS head,
    replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS body FROM b JOIN k USING (c) WHERE i > k.n OR side = 'c'),
s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY c, part ORDER BY i) AS e FROM f),
j AS (SELECT c, part, string_agg(head || body, '' ORDER BY i) AS x,
    string_agg(CAST(e - length(body) AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS y FROM s GROUP BY c, part)
SELECT k.c AS conv_id, CAST(k.n AS BIGINT) AS n_common, coalesce(max(x) FILTER (WHERE part = 'p'), '') AS prompt, coalesce(max(x) FILTER (WHERE part = 'c'), '') AS chosen,
  coalesce(max(x) FILTER (WHERE part = 'r'), '') AS rejected, coalesce(max(y) FILTER (WHERE part = 'c'), '') AS chosen_spans, coalesce(max(y) FILTER (WHERE part = 'r'), '') AS rejected_spans
FROM k LEFT JOIN j USING (c) GROUP BY k.c, k.n""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "conversations")
    out = preference_pairs(good, next_reply(good))

    def shown(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ",").alias(c)

    return out.select("conv_id", "n_common", "prompt", "chosen", "rejected", shown("chosen_spans"), shown("rejected_spans"))


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aligned(table(spark, sf_dir, "documents"))
    groups = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", groups, "links", "_block")
    return with_link_counts(out, piece_count())


@query(
    "op13_collocations",
    r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
s AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM s GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i+m-1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM s, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k+1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
z AS (SELECT k.*, p.f AS l, q.f AS r, (CAST(a AS HUGEINT) * 2000000) // (p.f + q.f) AS score FROM k JOIN f p ON p.lang = k.lang AND p.phrase = x JOIN f q ON q.lang = k.lang AND q.phrase = y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM z),
i AS (SELECT lang, array_to_string(w[s:s+j-1], ' ') AS phrase, max(a) AS f FROM (SELECT *, unnest(range(1, m - j + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS j FROM c)) GROUP BY ALL),
o AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
    FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE b.o = 1 AND (i.f IS NULL OR 100 * i.f < 80 * a))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM o JOIN t USING (lang) WHERE rank <= 2000""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
