"""Date, string, math, array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.functions import words as W
from quillwork.registry import query
from quillwork.sources.tables import table


@query(
    "date_parts",
    """SELECT event_id, CAST(day(ts) AS INTEGER) AS day_of_month, CAST(hour(ts) AS INTEGER) AS hour_of_day,
              CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(month(ts) AS INTEGER) AS month_of_year,
              CAST(year(ts) AS INTEGER) AS calendar_year, CAST(weekofyear(ts) AS INTEGER) AS iso_week,
              strftime(ts, '%Y-%m') AS year_month
       FROM events""",
)
def date_parts(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.dayofmonth("ts").alias("day_of_month"),
        F.hour("ts").alias("hour_of_day"),
        F.dayofyear("ts").alias("day_of_year"),
        F.month("ts").alias("month_of_year"),
        F.year("ts").alias("calendar_year"),
        F.weekofyear("ts").alias("iso_week"),
        F.date_format("ts", "yyyy-MM").alias("year_month"),
    )


@query(
    "text_length_by_class",
    """SELECT lang, count(*) AS n, round(avg(length(text)), 4) AS mean_length
       FROM documents GROUP BY lang""",
)
def text_length_by_class(spark, sf):
    sized = table(spark, sf, "documents").withColumn("length", F.length("text"))
    return sized.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 4).alias("mean_length")
    )


@query(
    "string_functions",
    """SELECT c_custkey, lower(c_name) AS lowered, upper(c_mktsegment) AS uppered,
              string_split(c_name, '#')[2] AS after_hash, substr(c_name, 2) AS without_first,
              list_extract([x for x in string_split_regex(' ' || c_mktsegment || '  ' || c_name || ' ', '\\s+')
                            if x <> ''], 2) AS second_word,
              len(string_split(c_mktsegment || '  ' || c_name, ' ')) AS blank_parts,
              regexp_extract(lower(c_name) || '@' || lower(c_mktsegment) || '.example', '([^@]*)$', 1) AS domain,
              'The customer ' || c_name || ' is in ' || c_mktsegment || '.' AS sentence
       FROM customer""",
)
def string_functions(spark, sf):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    padded = F.concat(F.lit(" "), segment, F.lit("  "), name, F.lit(" "))
    email = F.concat(F.lower(name), F.lit("@"), F.lower(segment), F.lit(".example"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.lower(name).alias("lowered"),
        F.upper(segment).alias("uppered"),
        F.get(F.split(name, "#"), F.lit(1)).alias("after_hash"),
        F.substring(name, 2, 2147483647).alias("without_first"),
        F.get(W.blank_split(padded), F.lit(1)).alias("second_word"),
        F.size(F.split(F.concat(segment, F.lit("  "), name), " ")).cast("bigint").alias("blank_parts"),
        W.email_domain(email).alias("domain"),
        F.format_string("The customer %s is in %s.", name, segment).alias("sentence"),
    )


@query(
    "word_presence_count",
    """SELECT doc_id, list_contains(w, 'the') AS has_word, len([x for x in w if x = 'the']) AS occurrences
       FROM (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS w FROM documents)""",
)
def word_presence_count(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        W.has_word(F.col("text"), "the").alias("has_word"),
        W.count_word(F.col("text"), "the").cast("bigint").alias("occurrences"),
    )


@query(
    "math_functions",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_partkey,
              l_quantity + l_linenumber AS added, l_quantity * l_linenumber AS multiplied,
              round(l_quantity / l_linenumber, 9) AS divided, l_partkey % 7 AS remainder,
              power(l_linenumber, 4) AS fourth_power, (2 + 3) * (5 + l_linenumber) AS grouped
       FROM lineitem""",
)
def math_functions(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_partkey",
        (q + n).alias("added"),
        (q * n).alias("multiplied"),
        F.round(F.try_divide(q, n), 9).alias("divided"),
        (F.col("l_partkey") % 7).alias("remainder"),
        F.pow(n, F.lit(4)).alias("fourth_power"),
        ((F.lit(2) + 3) * (F.lit(5) + n)).alias("grouped"),
    )


@query(
    "array_higher_order",
    """WITH a AS (SELECT p_partkey, p_size, range(p_size) AS r FROM part)
       SELECT p_partkey, array_to_string([x * 2 for x in r], ',') AS doubled,
              array_to_string([x for x in r if x % 2 = 0], ',') AS evens,
              array_to_string(list_append(r, 99), ',') AS appended,
              array_to_string(r[1:len(r) - 1], ',') AS without_last,
              list_contains(r, 3) AS has_three, len(r) AS n
       FROM a""",
)
def array_higher_order(spark, sf):
    r = F.col("r")
    # range(n): 0 .. n-1, empty for n = 0
    counted = F.when(F.col("p_size") > 0, F.sequence(F.lit(0), F.col("p_size") - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def text(a):
        return F.array_join(a.cast("array<string>"), ",")

    return (
        table(spark, sf, "part")
        .select("p_partkey", counted.alias("r"))
        .select(
            "p_partkey",
            text(F.transform(r, lambda x: x * 2)).alias("doubled"),
            text(F.filter(r, lambda x: x % 2 == 0)).alias("evens"),
            text(F.array_append(r, 99)).alias("appended"),
            text(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))).alias("without_last"),
            F.array_contains(r, 3).alias("has_three"),
            F.size(r).cast("bigint").alias("n"),
        )
    )


@query(
    "map_json_access",
    """WITH e AS (SELECT event_id, event_type, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
       SELECT event_id, CAST(k AS VARCHAR) AS message_field, k, k AS looked_up, 'k,type' AS map_keys,
              'k=' || k || ';type=' || event_type AS map_items, event_type AS nested_value
       FROM e""",
)
def map_json_access(spark, sf):
    parsed = F.from_json("props", "k bigint")
    tally = F.create_map(
        F.lit("k"), F.col("k").cast("string"), F.lit("type"), F.col("event_type")
    )
    # lst[1]['inner'][0] of a nested list and dictionary
    nested = F.array(
        F.create_map(F.lit("inner"), F.array(F.lit("none"))),
        F.create_map(F.lit("inner"), F.array(F.col("event_type"))),
    )
    return (
        table(spark, sf, "events")
        .select("event_id", "event_type", "props", parsed["k"].alias("k"))
        .withColumn("m", tally)
        .select(
            "event_id",
            F.get_json_object("props", "$.k").alias("message_field"),
            "k",
            F.element_at("m", "k").cast("bigint").alias("looked_up"),
            F.array_join(F.map_keys("m"), ",").alias("map_keys"),
            F.array_join(
                F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
            ).alias("map_items"),
            nested[1]["inner"][0].alias("nested_value"),
        )
    )


@query(
    "token_count",
    """SELECT conv_id, turn, len([x for x in string_split_regex(lower(text), '[^a-z0-9_]+') if x <> '']) AS tokens
       FROM conversations""",
)
def token_count(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(W.regex_words(F.col("text"))).cast("bigint").alias("tokens")
    )
