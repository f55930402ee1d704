"""Queries of tables and lookups: overrides, references, scopes, migrations, vector tables, caches, normal forms; with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.functions import vector
from quarry.operators import evaluation, schema, store, vector_table
from quarry.queries import _CORPUS, _MEM, _TAGS, _benchmark, _chunks, _memories, _quoted, query, table, words_sql
from quarry.sources import cache, catalog, files

_KEY = lambda t: rf"array_to_string(list_filter(string_split_regex(translate(lower(coalesce({t}, '')), '{X._ACCENTED}', '{X._PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), ' ')"

# A11-A13, B11-B13, B16, C2, C4, C7, C8, F4, F4b, J22 -------------------------------------------------------------------


def _store_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, documents and embeddings: documents are the sources, their rows the chunks."""
    rows = table(spark, sf_dir, "documents")
    text = F.lit(None).cast("string")
    chunks = rows.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("ordinal"), F.col("n_chars"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("memory_type"), F.when(F.col("doc_id") % 3 == 0, "own").alias("type_source"), F.when(F.col("doc_id") % 4 == 0, 0.9).alias("type_confidence"), F.when(F.col("doc_id") % 5 == 0, "fact").alias("memory_kind"),
    )
    known = F.substring("source", 4, 9).cast("int")
    documents = rows.select("source").distinct().select(
        F.col("source").alias("document_id"), F.concat("source", F.lit("/all.md")).alias("path"), F.when(known % 2 == 0, F.concat(F.lit("m"), "source")).alias("memory_id"),
        F.lit("general").alias("memory_type"), F.lit("rule").alias("type_source"), F.lit(0.5).alias("type_confidence"), F.when(known % 2 == 0, "episode").otherwise(text).alias("memory_kind"), F.when(known % 4 == 0, "resolved").otherwise(text).alias("memory_status"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", vector.l2_norm(F.col("embedding")).alias("norm"))
    return chunks, documents, vectors


_STORE = """SELECT doc_id AS chunk_id, source || '/all.md' AS path, n_chars, CASE WHEN k % 2 = 0 THEN 'm' || source END AS memory_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'general' END AS memory_type, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'rule' END AS type_source,
CASE WHEN doc_id % 4 = 0 THEN 0.9 ELSE 0.5 END AS type_confidence, CASE WHEN doc_id % 5 = 0 THEN 'fact' WHEN k % 2 = 0 THEN 'episode' END AS memory_kind, CASE WHEN k % 4 = 0 THEN 'resolved' WHEN k % 2 = 0 THEN 'active' END AS memory_status,
row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM (SELECT *, TRY_CAST(substr(source, 4, 9) AS INT) AS k FROM documents)"""
_OVERRIDDEN = ["chunk_id", "path", "memory_type", "type_source", "type_confidence", "memory_kind", "memory_status"]


@query(f"SELECT {', '.join(_OVERRIDDEN)}, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM ({_STORE}) JOIN embeddings ON vec_id = chunk_id")
def chunk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_overrides(*_store_tables(spark, sf_dir)).select(*_OVERRIDDEN, F.round("norm", 6).alias("norm"))


@query(f"SELECT {', '.join(_OVERRIDDEN)} FROM ({_STORE}) WHERE memory_type IN ('de', 'fr') AND chunk_id IN (SELECT doc_id FROM labels)")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labelled chunks, those of allowed types."""
    chunks, documents, _ = _store_tables(spark, sf_dir)
    return store.restricted(store.with_overrides(chunks, documents, types=["de", "fr"]), [None, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))]).select(*_OVERRIDDEN)


@query(f"SELECT chunk_id, ordinal, path FROM ({_STORE}) WHERE path = 'src1/all.md'")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, documents, _ = _store_tables(spark, sf_dir)
    return store.of_document(chunks, documents, "src1/all.md").select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "path")


@query(f"SELECT chunk_id FROM ({_CORPUS}) WHERE (path = 'src1' OR starts_with(path, 'src1/')) AND chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def combined_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "chunk_id")
    chunks = _chunks(spark, sf_dir)
    return store.excluding(store.restricted(chunks, [store.below(chunks, "src1"), None, labels.where("quality = 1")]), labels.where("toxic = 1")).select("chunk_id")


@query("SELECT doc_id, quality, doc_id AS hex_id, doc_id AS decimal_id, CAST(NULL AS BIGINT) AS bad_id FROM labels")
def chunk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References '#1f' and '31' back to the ids they stand for."""
    labels = table(spark, sf_dir, "labels").withColumn("h", F.concat(F.lit("#"), F.lower(F.hex("doc_id")))).withColumn("d", F.concat(F.lit(" "), F.col("doc_id").cast("string")))
    return labels.select("doc_id", "quality", store.reference_id(F.col("h")).alias("hex_id"), store.reference_id(F.col("d")).alias("decimal_id"), store.reference_id(F.concat("d", F.lit("x"))).alias("bad_id"))


@query("SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS context_id, doc_id AS chunk_id, n_chars, row_number() OVER (PARTITION BY quality ORDER BY doc_id % 17 DESC, doc_id) AS place FROM labels JOIN documents USING (doc_id)")
def context_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("context_id"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 17).alias("added_at"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    return store.context_listing(chunks, members).select("context_id", "chunk_id", "n_chars", "place")


@query("WITH r AS (SELECT item_id % 10 AS qid, source AS path, doc_id, n_chars / 1000.0 AS blended, row_number() OVER (PARTITION BY item_id % 10 ORDER BY n_chars DESC, doc_id, item_id) AS rank FROM documents JOIN benchmark ON item_id % 50 = doc_id % 50), f AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY rank) AS k FROM r WHERE blended >= 0.3 AND (path = 'src1' OR path LIKE 'src1/%' OR path = 'src2')) SELECT qid, path, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM f WHERE k = 1 AND path = 'src1'")
def post_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 50).join(table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 50).alias("k")), "k")
    rows = both.select((F.col("item_id") % 10).alias("qid"), F.col("source").alias("path"), "doc_id", "item_id", "n_chars", (F.col("n_chars") / 1000.0).alias("blended"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n_chars"), "doc_id", "item_id")))
    return store.post_filtered(rows, 0.3, "src1", files_only=True).select("qid", "path", "doc_id", "rank")


@query(rf"WITH v AS (SELECT doc_id, list_concat({words_sql('text')}[1:4], [upper(lang), '?', {words_sql('text')}[2], {words_sql('text')}[1] || ' !', source]) AS v FROM documents WHERE doc_id % 7 <> 3), f AS (SELECT doc_id, list_filter(v, lambda x: x IS NOT NULL AND {_KEY('x')} <> '') AS f FROM v), k AS (SELECT doc_id, f, list_transform(f, lambda x: {_KEY('x')}) AS k FROM f) SELECT doc_id, array_to_string(list_filter(f, lambda x, i: list_position(k, {_KEY('x')}) = i), '|') AS merged FROM k UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 7 = 3")
def merged_filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("doc_id") % 7 != 3

    def merged(w: Column) -> Column:
        right = F.filter(F.array(F.upper("lang"), F.lit("?"), F.get(w, F.lit(1)), F.concat(F.get(w, F.lit(0)), F.lit(" !")), F.col("source")), lambda x: x.isNotNull())
        return F.array_join(schema.merged_values(F.when(some, F.slice(w, 1, 4)), F.when(some, right)), "|")

    # in a lambda, so that a text is split once
    return table(spark, sf_dir, "documents").select("doc_id", F.get(F.transform(F.array(X.words(F.col("text"))), merged), F.lit(0)).alias("merged"))


@query(f"WITH m AS (SELECT *, kind || (id % 50) AS text FROM ({_MEM})), c AS (SELECT doc_id AS cand_id, CASE WHEN doc_id % 2 = 0 THEN 'fact' ELSE 'episode' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'fact' ELSE 'episode' END || (doc_id % 60) AS text FROM documents) SELECT cand_id, arg_max(id, (created_at, id)) AS id FROM c JOIN m USING (kind, text) WHERE status = 'active' GROUP BY cand_id")
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = _memories(spark, sf_dir).withColumn("text", F.concat("kind", (F.col("id") % 50).cast("string"))).withColumnRenamed("created_at", "updated_at")
    kind = F.when(F.col("doc_id") % 2 == 0, "fact").otherwise("episode")
    return store.duplicates(memories, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand_id"), kind.alias("kind"), F.concat(kind, (F.col("doc_id") % 60).cast("string")).alias("text")))


@query("SELECT c_custkey AS memory_id, o_orderkey AS document_id, o_orderpriority AS path, l_quantity AS access_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 1) ON l_orderkey = o_orderkey WHERE c_custkey = 7")
def memory_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.queries import memory_left_joins

    return memory_left_joins(spark, sf_dir).where("memory_id = 7")


@query(f"SELECT id, CASE WHEN id % 6 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN TIMESTAMP '2025-01-01' ELSE created_at END AS updated_at FROM ({_MEM})")
def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = _memories(spark, sf_dir).withColumnRenamed("created_at", "updated_at").select("id", "status", "updated_at")
    return store.with_status(memories, memories.where("id % 6 = 0").select("id", F.lit("archived").alias("status"), F.expr("timestamp'2025-01-01 00:00:00'").alias("updated_at")))


@query("SELECT o_orderkey AS memory_id, (SELECT min(c_custkey) FROM customer WHERE c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS document_id FROM orders")
def relinked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration's lookup of each memory's document by its path: a join where the old layout had a scalar subquery."""
    documents = table(spark, sf_dir, "customer").groupBy(F.col("c_name").alias("path")).agg(F.min("c_custkey").alias("document_id"))
    memories = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("memory_id"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("path"))
    return memories.join(documents, "path", "left").select("memory_id", "document_id")


# A15, A21, A22, G22, G23 ------------------------------------------------------------------------------------------------

_OLD_KIND = "CASE doc_id % 8 WHEN 0 THEN 'goal' WHEN 1 THEN ' Event' WHEN 2 THEN 'preference' WHEN 3 THEN 'observation' WHEN 4 THEN 'procedure' WHEN 5 THEN 'odd' WHEN 6 THEN 'Decision' END"
_NEW_KIND = "CASE lower(trim(coalesce(k, ''))) WHEN 'goal' THEN 'commitment' WHEN 'event' THEN 'episode' WHEN 'preference' THEN 'profile' WHEN 'observation' THEN 'handoff' WHEN 'procedure' THEN 'procedure' WHEN 'decision' THEN 'decision' ELSE 'fact' END"


def _old_kind() -> object:
    out, names = F.lit(None).cast("string"), ["goal", " Event", "preference", "observation", "procedure", "odd", "Decision"]
    for i, name in enumerate(names):
        out = F.when(F.col("doc_id") % 8 == i, name).otherwise(out)
    return out


@query(f"WITH m AS (SELECT doc_id, text, {_OLD_KIND} AS k FROM documents WHERE doc_id % 3 = 0), n AS (SELECT *, {_NEW_KIND} AS kind, list_filter({words_sql('text')}, lambda w: length(w) >= 3)[1:6] AS w FROM m) SELECT CAST(doc_id AS VARCHAR) AS id, kind, 'active' AS status, kind || ':' || array_to_string(w, '-') AS canonical_key FROM n")
def memories_of_version_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    documents = rows.select(F.col("doc_id").alias("document_id"), F.concat(F.when(F.col("doc_id") % 3 == 0, "memory://").otherwise("notes/"), F.col("doc_id").cast("string")).alias("path"), _old_kind().alias("memory_kind"), F.lit("t").alias("title"))
    chunks = rows.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), F.col("text").alias("content"))
    return catalog.memories_of_version_1(documents, chunks).select("id", "kind", "status", "canonical_key")


_V2 = [("preference", "prefer|favorite"), ("project", "project|repo"), ("goal", "goal|objective"), ("task", "todo|task|follow up"), ("tool", "tool|sdk|framework|sqlite"), ("time_sensitive", "today|tomorrow|deadline|urgent"), ("constraint", "constraint|blocked|cannot"), ("lesson", "lesson|learned|takeaway"), ("emotion", "feel|frustrated|happy"), ("identity_signal", "name|role|timezone")]
_V2_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{c}')" + (" OR turn % 9 = 4" if n == "preference" else "") + f" THEN '{n}' END" for n, c in _V2) + ", CASE turn % 3 WHEN 0 THEN 'fact_about_user' WHEN 1 THEN 'decision_topic' ELSE 'task' END], lambda x: x IS NOT NULL)"


@query(f"WITH f AS (SELECT conv_id, turn, {_V2_LIST} AS f FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i)[1:6], ',') AS facets FROM f")
def facets_of_version_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 0, " Profile").when(F.col("turn") % 3 == 1, "decision").otherwise("commitment")
    tags = F.when(F.col("turn") % 9 == 4, F.array(F.lit(" Preference "))).otherwise(F.array(F.lit("x")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(schema.facets_of_version_2(kind, F.coalesce("text", F.lit("")), tags), ",").alias("facets"))


_REL = "CASE doc_id % 6 WHEN 0 THEN 'a/b' || doc_id WHEN 1 THEN 'notes/' || doc_id || '.MD' WHEN 2 THEN 'x.' || lang || '.pdf' WHEN 3 THEN '  ' END"
_ID = "source || '..: ' || doc_id || '!'"


@query(rf"WITH d AS (SELECT doc_id, {_REL} AS r, CASE WHEN lang = 'en' THEN ' Markdown' WHEN lang = 'de' THEN 'code' WHEN lang = 'fr' THEN 'text' END AS k, {_ID} AS i FROM documents), e AS (SELECT doc_id, trim(coalesce(r, '')) AS r, CASE lower(trim(coalesce(k, ''))) WHEN 'code' THEN 'swift' WHEN 'text' THEN 'txt' ELSE 'md' END AS ext, trim(regexp_replace(i, '[^\p{{L}}\p{{N}}-]+', '_', 'g'), '_') AS safe FROM d) SELECT doc_id, CASE WHEN r = '' THEN safe || '.' || ext WHEN lower(regexp_extract(r, '\.([^./]+)$', 1)) IN ({_quoted(files.EXTENSIONS)}) THEN r WHEN regexp_extract(r, '\.([^./]+)$', 1) = '' THEN r || '.' || ext ELSE regexp_replace(r, '\.[^./]+$', '.') || ext END AS path FROM e")
def materialized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, id_ = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    relative = F.when(n == 0, F.concat(F.lit("a/b"), id_)).when(n == 1, F.concat(F.lit("notes/"), id_, F.lit(".MD"))).when(n == 2, F.concat(F.lit("x."), "lang", F.lit(".pdf"))).when(n == 3, "  ")
    kind = F.when(F.col("lang") == "en", " Markdown").when(F.col("lang") == "de", "code").when(F.col("lang") == "fr", "text")
    return table(spark, sf_dir, "documents").select("doc_id", files.materialized_path(F.concat("source", F.lit("..: "), id_, F.lit("!")), kind, relative).alias("path"))


@query(f"WITH p AS (SELECT DISTINCT path FROM ({_CORPUS})), n AS (SELECT path AS name, path AS want, 1 AS n FROM p UNION ALL SELECT upper(replace(path, '/', ' ')), path, 0 FROM p UNION ALL SELECT '/' || string_split(path, '/')[2], path, 1 FROM p UNION ALL SELECT 'no/such.md', NULL, 0) SELECT name, want AS path, n FROM n")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named by their path, by its comparison key, by its end; and one that isn't there."""
    docs = _chunks(spark, sf_dir).select("path").distinct()
    names = docs.select(F.explode(F.array(F.col("path"), F.upper(F.translate("path", "/", " ")), F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2)))).alias("name"))
    return store.resolved_paths(docs, names.unionByName(spark.createDataFrame([("no/such.md",)], "name string")))


_FOLD = lambda t: f"translate(lower({t}), '{X._ACCENTED}', '{X._PLAIN}')"
_TRIM = lambda t: rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _lines_sql() -> str:
    cases = []
    for c in ("c", "substr(c, 1, 180)", "s"):
        for d, p in (("d", c), (_FOLD("d"), _FOLD(c))):
            line = lambda end: f"len(string_split(substr(d, 1, {end}), chr(10)))"  # noqa: B023, E731
            cases.append(f"WHEN length({c}) >= 8 AND instr({d}, {p}) > 0 THEN [{line(f'instr({d}, {p}) - 1')}, {line(f'instr({d}, {p}) + length({c}) - 2')}]")
    nl = lambda t: rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    piece = "CASE doc_id % 3 WHEN 0 THEN substr(text, 101, 300) WHEN 1 THEN translate(substr(text, 41, 200), 'aeiou', 'AEIOU') ELSE substr(text, 11, 190) || '#~#' END"
    return f"""WITH r AS (SELECT doc_id, {nl('text')} AS d, {_TRIM(nl(piece))} AS c, {_TRIM(nl('substr(text, 21, 40)'))} AS s FROM documents), l AS (SELECT doc_id, CASE {' '.join(cases)} END AS l FROM r)
SELECT doc_id, l[1] AS first_line, l[2] AS last_line FROM l"""


@query(_lines_sql())
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), F.col("doc_id") % 3
    chunk = F.when(n == 0, F.substring(t, 101, 300)).when(n == 1, F.translate(F.substring(t, 41, 200), "aeiou", "AEIOU")).otherwise(F.concat(F.substring(t, 11, 190), F.lit("#~#")))
    found = table(spark, sf_dir, "documents").select("doc_id", store.line_range(t, chunk, F.substring(t, 21, 40)).alias("r"))
    return found.select("doc_id", F.col("r.start").cast("long").alias("first_line"), F.col("r.end").cast("long").alias("last_line"))


# Cached answers ----------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), (F.col("user_id") % 40).cast("string").alias("u"), F.date_format("ts", "yyyy-MM-dd").alias("d"))
    return rows.withColumn("cache_key", cache.cache_key(F.col("namespace"), F.col("u"), F.col("d")))


@query("WITH r AS (SELECT event_type AS namespace, CAST(user_id % 40 AS VARCHAR) AS u, strftime(ts, '%Y-%m-%d') AS d FROM events) SELECT namespace, count_if(CAST(u AS INT) % 3 = 0) AS hits, count_if(CAST(u AS INT) % 3 <> 0) AS misses, round(count_if(CAST(u AS INT) % 3 = 0) / count(*), 6) AS hit_rate FROM r GROUP BY namespace")
def cache_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    known = requests.where("CAST(u AS INT) % 3 = 0").dropDuplicates(["cache_key"]).select("cache_key", "namespace", F.lit("{}").alias("payload"), F.lit(1.0).alias("updated_at"))
    return cache.hit_rates(cache.loaded(known, requests))


@query("WITH r AS (SELECT DISTINCT event_type || chr(31) || (user_id % 40) || chr(31) || strftime(ts, '%Y-%m-%d') AS cache_key, event_type AS namespace, user_id % 40 AS u FROM events) SELECT cache_key, namespace, CASE WHEN u % 2 = 0 THEN 'new' ELSE 'old' END AS payload FROM r WHERE u % 3 = 0 OR u % 2 = 0")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of a third of the requests after answers to half of them were stored."""
    rows = _requests(spark, sf_dir)
    old = rows.where("CAST(u AS INT) % 3 = 0").dropDuplicates(["cache_key"]).select("cache_key", "namespace", F.lit("old").alias("payload"), F.lit(1.0).alias("updated_at"))
    new = rows.where("CAST(u AS INT) % 2 = 0").select("cache_key", "namespace", F.explode(F.array(F.struct(F.lit("older").alias("payload"), F.lit(2.0).alias("updated_at")), F.struct(F.lit("new").alias("payload"), F.lit(3.0).alias("updated_at")))).alias("a")).select("cache_key", "namespace", "a.*")
    return cache.stored(old, new).select("cache_key", "namespace", "payload")


# Vector tables -----------------------------------------------------------------------------

VECTORS = vector_table.declared("vec_id integer primary key", "label integer partition key", "embedding float[{dims}] distance_metric=cosine".format(dims=64), "small int8[64]", "signs bit[64]", "even boolean", "score float", "name text", "+note text", "chunk_size=256")


def _vector_rows(spark: SparkSession, sf_dir: str) -> tuple[vector_table.Declaration, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    dims = e.select(F.size("embedding").alias("n")).first().n
    of = vector_table.declared("vec_id integer primary key", "label integer partition key", f"embedding float[{dims}] distance_metric=cosine", f"small int8[{dims}]", f"signs bit[{dims}]", "even boolean", "score float", "name text", "+note text", "chunk_size=256")
    v = F.col("embedding")
    rows = e.select("vec_id", "label", "embedding", vector.quantized_int8(v).alias("small"), vector.quantized_binary(v).alias("signs"), (F.col("vec_id") % 2 == 0).alias("even"), (F.col("vec_id") / 10.0).alias("score"), F.concat(F.lit("n"), (F.col("vec_id") % 5).cast("string")).alias("name"), F.concat(F.lit("note "), F.col("vec_id").cast("string")).alias("note"))
    return of, vector_table.inserted(of, spark.createDataFrame([], of.schema()), rows)


_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"WITH {_E}, d AS (SELECT a.vec_id AS qid, b.vec_id, b.label, round(abs(1 - list_cosine_similarity(a.v, b.v)), 6) AS distance FROM e a JOIN e b ON b.label >= 2 AND b.label <> 5 AND b.vec_id % 2 = 0 AND b.vec_id / 10.0 < 60 AND b.vec_id % 5 IN (0, 2, 3) AND b.vec_id % 50 <> 7 WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM d) SELECT qid, vec_id, label, 'note ' || vec_id AS note, distance, rank FROM r WHERE rank <= 5")
def vec_table_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours under conditions on partition key and metadata, among given keys; queries are the rows whose id is divisible by 50."""
    of, rows = _vector_rows(spark, sf_dir)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    where = [("label", ">=", 2), ("label", "!=", 5), ("even", "=", True), ("score", "<", 60.0), ("name", "IN", ["n0", "n2", "n3"])]
    found = vector_table.knn(of, rows, asked, 5, "embedding", where, rows.where("vec_id % 50 <> 7"))
    return found.select("qid", "vec_id", "label", "note", F.abs("distance").alias("distance"), "rank")


@query(f"WITH {_E}, d AS (SELECT a.vec_id AS qid, b.vec_id, CAST(len(list_filter(range(1, len(a.v) + 1), lambda i: (a.v[i] > 0) <> (b.v[i] > 0))) AS DOUBLE) AS distance FROM e a JOIN e b ON true WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM d) SELECT * FROM r WHERE rank <= 5")
def vec_table_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    of, rows = _vector_rows(spark, sf_dir)
    return vector_table.knn(of, rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("signs").alias("embedding")), 5, "signs").select("qid", "vec_id", "distance", "rank")


@query(f"WITH {_E} SELECT vec_id, label, vec_id % 2 = 0 AS even, vec_id / 10.0 AS score, 'n' || (vec_id % 5) AS name, 'note ' || vec_id AS note, round(list_sum(v), 6) AS total FROM e WHERE vec_id = 11")
def vec_table_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key, with all its partition, metadata, auxiliary and vector values."""
    of, rows = _vector_rows(spark, sf_dir)
    return vector_table.point(of, rows, 11).select("vec_id", "label", "even", "score", "name", "note", F.round(F.aggregate(vector.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {_E}, c AS (SELECT vec_id, label, CASE WHEN vec_id % 4 = 0 THEN 'changed' ELSE 'n' || (vec_id % 5) END AS name, CASE WHEN vec_id % 4 = 0 THEN -1.0 ELSE vec_id / 10.0 END AS score FROM e WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id + 1000000, label, 'new', NULL FROM e WHERE vec_id % 10 = 1) SELECT *, row_number() OVER (ORDER BY label, vec_id) AS place FROM c")
def vec_table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows deleted, updated and inserted (also some that are there already), read back in order."""
    of, rows = _vector_rows(spark, sf_dir)
    left = vector_table.deleted(of, rows, rows.where("vec_id % 3 = 0"))
    left = vector_table.updated(of, left, rows.where("vec_id % 4 = 0").select("vec_id", F.lit("changed").alias("name"), F.lit(-1.0).alias("score")))
    more = rows.where("vec_id % 10 = 1").select(F.explode(F.when(F.col("vec_id") % 3 != 0, F.array("vec_id", F.col("vec_id") + 1_000_000)).otherwise(F.array(F.col("vec_id") + 1_000_000))).alias("vec_id"), "label", "embedding", "small", "signs", F.lit("new").alias("name"))
    full = vector_table.scan(of, vector_table.inserted(of, left, more))
    return full.select("vec_id", "label", "name", "score", F.row_number().over(Window.orderBy("label", "vec_id")).alias("place"))


@query(f"WITH {_E} SELECT vec_id, len(v) AS length, 'float32' AS kind, '[' || array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',') || ']' AS text, 0.0 AS json_error, '[' || array_to_string(list_transform(v, lambda x: CAST(x > 0 AS INT)), ',') || ']' AS bits, true AS round_trip, 'v1' AS version FROM e")
def vec_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, type, JSON form and back, bytes and back."""
    v = F.col("embedding").cast("array<float>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), vector.quantized_binary(v).alias("b"), vector.to_json(v).alias("text"))
    rows = rows.withColumn("back", vector.from_json(F.col("text"))).withColumn("bits", vector.whole_to_json(F.col("b")))
    off = F.array_max(F.zip_with(vector.doubles(F.col("v")), vector.doubles(F.col("back")), lambda x, y: F.abs(x - y)))
    same = (vector.from_json(F.col("bits"), "bit") == F.col("b")) & vector.from_json(F.lit("[1, 2.5]"), "int8").isNull() & vector.from_json(F.lit("[1, null]")).isNull() & vector.from_json(F.lit("no")).isNull()
    blob = F.unhex(F.lit("0000803f000020c0"))  # 1.0 and -2.5
    same = same & (vector.from_blob(blob) == F.array(F.lit(1.0), F.lit(-2.5)).cast("array<float>")) & (vector.from_blob(F.unhex(F.lit("ff7f")), "int8") == F.array(F.lit(-1), F.lit(127))) & (vector.from_blob(F.unhex(F.lit("05")), "bit") == F.array(*map(F.lit, (1, 0, 1, 0, 0, 0, 0, 0))))
    kind = dict(rows.dtypes)["v"]
    return rows.select("vec_id", F.size("v").cast("long").alias("length"), F.lit(vector.kind_of(kind)).alias("kind"), "text", F.round(off, 5).alias("json_error"), "bits", same.alias("round_trip"), F.lit(vector.VERSION).alias("version"))


@query("WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, 1.0 + vec_id % 3 AS w FROM embeddings), u AS (SELECT label, w, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM e), p AS (SELECT label, i, sum(w * x) / sum(w) AS m FROM u GROUP BY ALL) SELECT label, round(sum(m), 6) AS weighted, round(sqrt(sum(m * m)), 6) AS norm FROM p GROUP BY label")
def vec_weighted_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list("embedding").alias("v"), F.collect_list((F.col("vec_id") % 3 + 1).cast("double")).alias("w"), F.first(F.size("embedding")).alias("n"))
    dims = table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("n")).first().n
    m = vector.weighted_mean_pooled(F.col("v"), F.col("w"), dims)
    return e.select("label", m.alias("m")).select("label", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("weighted"), F.round(vector.l2_norm(F.col("m")), 6).alias("norm"))


# Normal forms and text tools ----------------------------------------------------------------------------------


@query("WITH h AS (SELECT doc_id % 40 AS qid, lang AS tag, least(1.0, greatest(0.0, n_chars / 900.0 - 0.2)) AS confidence, doc_id % 2 = 0 AS explicit FROM documents), b AS (SELECT qid, tag, max(confidence) AS confidence FROM h GROUP BY ALL), x AS (SELECT qid, tag, b.confidence, bool_or(explicit) AS explicit FROM b JOIN h USING (qid, tag, confidence) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, explicit DESC, tag) AS place FROM x) SELECT qid, tag, round(confidence, 6) AS confidence, explicit, place FROM r WHERE place <= 3")
def normalized_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("qid"), F.col("lang").alias("tag"), (F.col("n_chars") / 900.0 - 0.2).alias("confidence"), (F.col("doc_id") % 2 == 0).alias("explicit"))
    return schema.normalized_hints(hints, 3).withColumn("confidence", F.round("confidence", 6))


@query(rf"WITH {_TAGS}, u AS (SELECT chunk_id % 100 AS id, unnest(t) AS n, unnest(range(0, len(t))) AS i FROM tg), v AS (SELECT id, CASE WHEN i % 2 = 0 THEN n ELSE n || '!' END AS name, greatest(0.2, 1 - 0.08 * i) AS confidence FROM u), k AS (SELECT *, {_KEY('name')} AS k FROM v), o AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY confidence DESC, name) AS n FROM k), r AS (SELECT id, name, confidence, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, name) AS place FROM o WHERE n = 1) SELECT id, name, round(confidence, 6) AS confidence, place FROM r WHERE place <= 10")
def normalized_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _chunks(spark, sf_dir).select((F.col("chunk_id") % 100).alias("id"), F.posexplode(X.tags(F.col("content"))).alias("i", "n"))
    rows = tags.select("id", F.when(F.col("i") % 2 == 0, F.concat(F.lit("  "), F.col("n"))).otherwise(F.concat("n", F.lit("!\t"))).alias("name"), F.greatest(F.lit(0.2), 1 - 0.08 * F.col("i")).alias("confidence"))
    return schema.normalized_tags(rows, 10).withColumn("confidence", F.round("confidence", 6))


@query("WITH RECURSIVE r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, (length(coalesce(text, '')) + turn) % 7 AS rel FROM conversations), w AS (SELECT conv_id, i, rel, CASE WHEN rel BETWEEN 1 AND 5 THEN (rel - 1) / 4.0 END AS share FROM r WHERE i = 0 UNION ALL SELECT r.conv_id, r.i, r.rel, CASE WHEN r.rel BETWEEN 1 AND 5 AND (w.share IS NULL OR (r.rel - 1) / 4.0 <= w.share + 0.35) THEN (r.rel - 1) / 4.0 ELSE w.share END FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1), p AS (SELECT *, lag(share) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM w) SELECT conv_id, i AS place, round(CASE WHEN rel BETWEEN 1 AND 5 AND (before IS NULL OR (rel - 1) / 4.0 <= before + 0.35) THEN greatest(0.1, 0.6 * ((rel - 1) / 4.0) + 0.4 * greatest(0.1, pow(0.88, i))) ELSE greatest(0.1, pow(0.88, i)) END, 6) AS confidence FROM p")
def tag_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.length(F.coalesce("text", F.lit(""))) + F.col("turn")) % 7).cast("int").alias("rel"))
    ranked = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "rel"))), lambda x: x["rel"]).alias("rel"))
    return ranked.select("conv_id", F.posexplode(schema.tag_confidences(F.col("rel"))).alias("place", "confidence")).withColumn("confidence", F.round("confidence", 6)).withColumn("place", F.col("place").cast("long"))


_TOK = lambda t: rf"list_filter({words_sql(t)}, lambda w: length(w) >= 3 AND w NOT IN ({_quoted(X.QUERY_STOP_WORDS)}))"
_WIN = lambda n: f"list_transform(list_filter(range(1, len(tk) - {n - 2}), lambda i: len(list_distinct(tk[i:i + {n - 1}])) = {n}), lambda i: array_to_string(tk[i:i + {n - 1}], ' '))"


@query(
    rf"""WITH d AS (SELECT doc_id, text, {_TOK("text")} AS tk FROM documents), p AS (SELECT doc_id, list_concat({_WIN(3)}, {_WIN(2)}) AS p FROM d), q AS (SELECT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:6] AS p FROM p)
SELECT d.doc_id, sha1(CAST(d.doc_id AS VARCHAR)) AS stable, array_to_string(q.p, '|') AS phrases, {_FOLD("coalesce(substr(text, 1, 60), '')")} AS match_key, CASE WHEN len(tk) > 0 THEN round((3.0 * len(list_intersect(list_distinct(tk), list_distinct(tk[1:5]))) + 0.25 * len(list_intersect(list_distinct(tk), list_distinct(tk[4:12])))) / sqrt(len(list_distinct(tk))), 6) ELSE 0 END AS similarity FROM d JOIN q USING (doc_id)"""
)
def dataset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    words = evaluation.tokens(t)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha1(F.col("doc_id").cast("string")).alias("stable"), F.array_join(evaluation.phrase_candidates(t, 6), "|").alias("phrases"), X.match_key(F.substring(t, 1, 60)).alias("match_key"), F.round(evaluation.lexical_similarity(F.slice(words, 1, 5), words, F.slice(words, 4, 9)), 6).alias("similarity")
    )


@query(
    rf"""WITH q AS (SELECT item_id, list_distinct({_TOK("text")}) AS q FROM benchmark), d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS k, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents), n AS (SELECT item_id, q, row_number() OVER (ORDER BY item_id) - 1 AS k FROM q),
s AS (SELECT doc_id, t, q, unnest(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, unnest(range(0, len(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) AS i FROM d JOIN n USING (k)),
b AS (SELECT doc_id, any_value(t) AS t, arg_max(trim(s), (len(list_intersect(q, list_distinct({_TOK("s")}))), -i)) AS best FROM s WHERE trim(s) <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(best) <= 120 THEN best ELSE regexp_replace(best[1:120], ' [^ ]*$', '') END AS sentence FROM b"""
)
def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, the sentence that shares most with a benchmark item."""
    items = _benchmark(spark, sf_dir).select((F.row_number().over(Window.orderBy("qid")) - 1).alias("k"), F.array_distinct(evaluation.tokens(F.col("text"))).alias("q"))
    n = items.count()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("k"))
    return docs.join(items, "k").select("doc_id", evaluation.best_sentence(F.col("text"), F.col("q")).alias("sentence")).where("sentence <> ''")
