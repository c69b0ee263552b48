"""Readers and writers: every query writes a whole table in some format and reads it back."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.operators import records
from quillwork.registry import query
from quillwork.sources import nameindex, tables, writers
from quillwork.sources.tables import table
from quillwork.streaming import counts


def _orders_with_gaps(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        "o_totalprice",
    )


_GAPS = """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
                  o_orderstatus, o_totalprice FROM orders"""


@query("src_json_inferred", _GAPS)
def src_json_inferred(spark, sf):
    # the writer leaves null cells out, so the reader meets rows without the key
    path = writers.write_fresh(_orders_with_gaps(spark, sf), "json", "json")
    return tables.read_json(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("src_json_schema", f"SELECT * REPLACE (CAST(o_custkey AS INTEGER) AS o_custkey) FROM ({_GAPS})")
def src_json_schema(spark, sf):
    path = writers.write_fresh(_orders_with_gaps(spark, sf), "json", "json")
    schema = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType(), True),
            T.StructField("o_custkey", T.IntegerType(), True),
            T.StructField("o_orderstatus", T.StringType(), True),
            T.StructField("o_totalprice", T.DoubleType(), True),
        ]
    )
    return tables.read_json(spark, path, schema)


@query(
    "src_csv_inferred",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS ordered_on,
              o_orderpriority FROM orders""",
)
def src_csv_inferred(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("ordered_on"),
        "o_orderpriority",
    )
    back = tables.read_csv(spark, writers.write_fresh(rows, "csv", "csv", header=True))
    # the inferred width of the key depends on its largest value
    return back.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query(
    "src_tsv_rename",
    """SELECT lang AS class, CASE WHEN line = '' THEN NULL ELSE line END AS text
       FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)""",
)
def src_tsv_rename(spark, sf):
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    path = writers.write_fresh(lines.select(F.concat_ws("\t", "lang", "line").alias("value")), "tsv", "text")
    return tables.read_delimited(spark, path, ["class", "text"])


@query(
    "src_parquet",
    """SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem""",
)
def src_parquet(spark, sf):
    # a file per task: the input's own splits are the chunks, without a shuffle
    path = writers.write_fresh(table(spark, sf, "lineitem"), "parquet-folder")
    return spark.read.parquet(path).select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@query(
    "src_libsvm",
    """SELECT CAST(l_linenumber AS DOUBLE) AS label, l_quantity AS f1, abs(l_discount) AS f2, l_tax AS f3
       FROM lineitem""",
)
def src_libsvm(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("label"),
        "l_quantity",
        F.abs("l_discount").alias("discount"),
        "l_tax",
    )
    assembled = VectorAssembler(inputCols=["l_quantity", "discount", "l_tax"], outputCol="features")
    path = writers.write_fresh(assembled.transform(items).select("label", "features"), "libsvm", "libsvm")
    values = vector_to_array("features")
    return tables.read_libsvm(spark, path, features=3).select(
        "label", values[0].alias("f1"), values[1].alias("f2"), values[2].alias("f3")
    )


@query(
    "src_inline",
    """SELECT CAST(r.urgency AS BIGINT) AS urgency, count(*) AS n
       FROM orders o JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 0),
                                  ('5-LOW', 1)) r(priority, urgency) ON o.o_orderpriority = r.priority
       GROUP BY r.urgency""",
)
def src_inline(spark, sf):
    rows = [("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 0), ("5-LOW", 1)]
    urgency = spark.createDataFrame(rows, ["o_orderpriority", "urgency"])
    counted = table(spark, sf, "orders").join(F.broadcast(urgency), "o_orderpriority")
    return counted.groupBy("urgency").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingest_bounded",
    """SELECT page_id, url, length(html) AS size FROM pages ORDER BY page_id LIMIT 50""",
)
def ingest_bounded(spark, sf, num_pages=50):
    first = table(spark, sf, "pages").orderBy("page_id").limit(num_pages)
    return first.select("page_id", "url", F.length("html").cast("bigint").alias("size"))


def _page_rows(spark, sf, rows_per_chunk):
    return writers.page_rows(table(spark, sf, "pages"), "page_id", "url", "html", rows_per_chunk)


_PAGE_ROWS = """SELECT row_number() OVER (ORDER BY page_id) - 1 AS idx,
                       (row_number() OVER (ORDER BY page_id) - 1) // 100 AS chunk,
                       page_id, url AS page_name, html AS content FROM pages"""


@query("ingest_page_rows", _PAGE_ROWS)
def ingest_page_rows(spark, sf):
    return _page_rows(spark, sf, 100)


@query(
    "select_record_kind",
    """SELECT doc_id, source, kind FROM
         (SELECT doc_id, source, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS kind FROM documents)
       WHERE kind = 2""",
)
def select_record_kind(spark, sf):
    tag = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    tagged = table(spark, sf, "documents").select("doc_id", "source", tag.alias("kind"))
    paragraphs, _ = records.split_by_kind(tagged, "kind", "paragraphs")
    return records.require_kind(paragraphs, "kind", "paragraphs")


@query(
    "get_doc_by_position",
    """SELECT doc_id, lang, source, text FROM documents ORDER BY doc_id LIMIT 1 OFFSET 42""",
)
def get_doc_by_position(spark, sf, n=42):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return records.nth_record(docs, "doc_id", n)


@query(
    "lookup_by_name",
    """WITH names AS (SELECT DISTINCT string_split(url, '?')[1] AS page_name FROM pages)
       SELECT n.page_name, p.page_id, length(p.html) AS size
       FROM names n LEFT JOIN pages p ON p.url = n.page_name""",
)
def lookup_by_name(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("url").alias("page_name"), "page_id", F.length("html").cast("bigint").alias("size")
    )
    # addresses without their query part: those that had one are not page names
    asked = pages.select(F.substring_index("page_name", "?", 1).alias("page_name")).distinct()
    return nameindex.lookup_by_name(asked, pages, "page_name")


@query(
    "sink_parquet_roundtrip",
    """SELECT * FROM events""",
)
def sink_parquet_roundtrip(spark, sf):
    return spark.read.parquet(writers.write_fresh(table(spark, sf, "events"), "events"))


@query(
    "sink_chunked_parquet",
    f"""SELECT chunk, count(*) AS n_rows, 1 AS n_files, sum(length(content))::BIGINT AS n_chars,
               min(idx) AS first_idx, max(idx) AS last_idx
        FROM ({_PAGE_ROWS}) GROUP BY chunk""",
)
def sink_chunked_parquet(spark, sf):
    path = writers.write_chunks(_page_rows(spark, sf, 100), "page-chunks")
    return (
        spark.read.parquet(path)
        .groupBy(F.col("chunk").cast("bigint").alias("chunk"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(F.col("_metadata.file_path")).cast("int").alias("n_files"),
            F.sum(F.length("content")).alias("n_chars"),
            F.min("idx").alias("first_idx"),
            F.max("idx").alias("last_idx"),
        )
    )


@query(
    "sink_csv_roundtrip",
    """SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def sink_csv_roundtrip(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = writers.write_fresh(rows, "customer-csv", "csv", header=True)
    return tables.read_csv(spark, path, rows.schema)


@query(
    "schema_profile",
    """SELECT 'doc_id' AS column_name, 'bigint' AS type, true AS nullable, count(doc_id) AS n_present FROM documents
       UNION ALL SELECT 'text', 'string', true, count(text) FROM documents
       UNION ALL SELECT 'lang', 'string', true, count(lang) FROM documents
       UNION ALL SELECT 'source', 'string', true, count(source) FROM documents
       UNION ALL SELECT 'n_chars', 'bigint', true, count(n_chars) FROM documents""",
)
def schema_profile(spark, sf):
    docs = table(spark, sf, "documents")
    listing = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.nullable).alias("nullable"),
            F.col(f.name).alias("n_present"),
        )
        for f in docs.schema
    ]
    present = docs.agg(*[F.count(c).alias(c) for c in docs.columns])
    return present.select(F.inline(F.array(*listing)))


@query(
    "ingest_metrics",
    f"""SELECT count(*) AS rows_done, max(chunk) + 1 AS chunks_done, sum(length(content))::BIGINT AS chars_done
        FROM ({_PAGE_ROWS})""",
)
def ingest_metrics(spark, sf):
    metrics = writers.observed_write(
        _page_rows(spark.newSession(), sf, 100),
        "page-rows",
        rows_done=F.count(F.lit(1)),
        chunks_done=F.max("chunk") + 1,
        chars_done=F.sum(F.length("content")),
    )
    return spark.createDataFrame(
        [tuple(metrics[c] for c in ("rows_done", "chunks_done", "chars_done"))],
        "rows_done bigint, chunks_done bigint, chars_done bigint",
    )


# Chunk files a batch of the ingest takes: what a batch costs by itself is shared by so many chunks.
CHUNKS_A_BATCH = 256


@query(
    "ingest_progress",
    f"""SELECT chunk, count(*) AS rows, sum(length(content))::BIGINT AS chars, true AS timed
        FROM ({_PAGE_ROWS.replace("100", "200")}) GROUP BY chunk""",
)
def ingest_progress(spark, sf):
    """A row for each chunk that is ingested; the times differ from run to run, so the query tells that they are there."""
    rows = _page_rows(spark, sf, 200)
    own = counts.stream_session(spark)
    chunks = counts.file_stream(own, writers.write_chunks(rows, "progress-input"), rows.schema, files_per_batch=CHUNKS_A_BATCH)
    progress = counts.chunk_progress(own, chunks, "chunk", "content")
    timed = (F.col("seconds") > 0) & (F.abs(F.col("seconds_a_row") * F.col("rows") - F.col("seconds")) < 1e-6)
    return progress.select("chunk", "rows", "chars", timed.alias("timed"))


@query(
    "name_index_lookup",
    """WITH names AS (SELECT CASE WHEN page_id % 4 = 0 THEN url ELSE url || '#missing' END AS page_name, page_id AS asked_by
                      FROM pages WHERE page_id % 2 = 0)
       SELECT n.page_name, asked_by, p.page_id, length(p.html) AS size
       FROM names n LEFT JOIN pages p ON p.url = n.page_name""",
)
def name_index_lookup(spark, sf):
    """Half of the pages ask for a page by name, through an index of names; half of these names do not exist."""
    pages = table(spark, sf, "pages")
    index = nameindex.build_name_index(
        pages.select(F.col("url").alias("page_name"), "page_id", F.length("html").cast("bigint").alias("size")), "page_name"
    )
    name = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.concat("url", F.lit("#missing")))
    asked = pages.where("page_id % 2 = 0").select(name.alias("page_name"), F.col("page_id").alias("asked_by"))
    return index.lookup(asked)
