"""Filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import calendar as C
from tessera.functions import predicates as P
from tessera.functions import text as T
from tessera.functions import transforms as X
from tessera.plans.registry import query


@query("f_eq", "SELECT o_orderkey FROM orders WHERE coalesce(o_orderstatus = 'F', false)")
def f_eq(t):
    return t.orders.where(P.eq("o_orderstatus", "F")).select("o_orderkey")


@query("f_neq_missing_is_true", "SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.k') <> 'x', true) AND coalesce(event_type <> 'click', true)")
def f_neq(t):
    return t.events.withColumn("k", F.get_json_object("props", "$.k")).where(P.all_of(P.neq("k", "x"), P.neq("event_type", "click"))).select("event_id")


@query("f_in", "SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase')")
def f_in(t):
    return t.events.where(P.is_in("event_type", ["signup", "purchase"])).select("event_id")


@query("f_range_open_ended", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_discount <= 0.05 AND l_discount >= 0.02")
def f_range(t):
    return t.lineitem.where(P.all_of(P.in_range("l_quantity", 45), P.in_range("l_discount", 0.02, 0.05))).select("l_orderkey", "l_linenumber")


@query("f_contains_array_or_exact", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'TIN') OR p_brand = 'Brand#12'")
def f_contains(t):
    return t.part.withColumn("tags", F.split("p_type", " ")).where(P.any_of(P.contains("tags", "TIN"), P.contains("p_brand", "Brand#12", is_array=False))).select("p_partkey")


@query("f_builder", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand <> 'Brand#11'")
def f_builder(t):
    return t.part.where(P.FilterBuilder().in_range("p_size", 10, 20).neq("p_brand", "Brand#11").build()).select("p_partkey")


@query("f_empty_and_or", "SELECT count(*) AS n FROM nation WHERE true AND NOT false")
def f_empty(t):
    return t.nation.where(P.all_of() & ~P.any_of()).agg(F.count("*").alias("n"))


@query("f_scope_folder", "SELECT doc_id FROM documents WHERE starts_with(source || '/' || lang, 'src1')")
def f_scope(t):
    return t.documents.where(P.in_scope(F.concat_ws("/", "source", "lang"), "folder:src1")).select("doc_id")


@query("f_name_substring", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def f_name(t):
    return t.part.where(P.name_contains("p_name", "AN")).select("p_partkey", "p_name")


@query("f_name_or_alias_substring", "SELECT p_partkey FROM part WHERE contains(lower(p_name), '2') OR len(list_filter(string_split(p_brand, '#'), lambda x: contains(lower(x), '2'))) > 0")
def f_alias(t):
    return t.part.withColumn("aliases", F.split("p_brand", "#")).where(P.name_contains("p_name", "2", "aliases")).select("p_partkey")


@query("f_time_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def f_time(t):
    return t.orders.where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1995-12-31").cast("timestamp"))).select("o_orderkey")


_V = "CAST(CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS VARCHAR) ELSE l_returnflag END AS VARCHAR)"


@query("x_arithmetic_passes_text", f"""
WITH v AS (SELECT l_orderkey, l_linenumber, {_V} AS s FROM lineitem)
SELECT l_orderkey, l_linenumber,
       CASE WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN round(try_cast(s AS DOUBLE) * 2.5, 4) END AS multiplied,
       CASE WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN round(try_cast(s AS DOUBLE) + 3, 4) END AS added,
       CASE WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN round(try_cast(s AS DOUBLE) - 3, 4) END AS subtracted,
       CASE WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN round(try_cast(s AS DOUBLE) / 4, 4) END AS divided,
       CASE WHEN try_cast(s AS DOUBLE) IS NULL THEN s END AS passed
FROM v""")
def x_arith(t):
    v = t.lineitem.withColumn("s", F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("string")).otherwise(F.col("l_returnflag")))
    num = lambda c: F.round(c.try_cast("double"), 4)
    s = F.col("s")
    return v.select("l_orderkey", "l_linenumber", num(X.multiply(s, 2.5)).alias("multiplied"), num(X.add(s, 3)).alias("added"), num(X.subtract(s, 3)).alias("subtracted"), num(X.divide(s, 4)).alias("divided"), F.when(s.try_cast("double").isNull(), X.divide(X.multiply(s, 2), 0)).alias("passed"))


@query("x_round_half_up", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10 + 0.5) / 10 AS r1, floor(-l_quantity / 2 + 0.5) AS r0 FROM lineitem")
def x_round(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.round_half_up(F.col("l_extendedprice"), 1).alias("r1"), X.round_half_up(-F.col("l_quantity") / 2).alias("r0"))


@query("x_floor_ceil_negate", "SELECT o_orderkey, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, -o_totalprice AS n, CASE WHEN o_orderstatus = 'F' THEN 'false' ELSE 'true' END AS b FROM orders")
def x_floor(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", X.floor(p).cast("double").alias("f"), X.ceil(p).cast("double").alias("c"), X.negate(p).cast("double").alias("n"), X.negate(F.col("o_orderstatus") == "F").alias("b"))


@query("x_text_chain", "SELECT c_custkey, '<' || upper(c_mktsegment) || '>' AS a, lower(c_name) || '!' AS b FROM customer")
def x_text(t):
    return t.customer.select("c_custkey", X.apply_chain(F.col("c_mktsegment"), "uppercase|prefix:<|suffix:>").alias("a"), X.apply_chain(F.col("c_name"), "lowercase|suffix:!").alias("b"))


@query("x_numeric_chain", "SELECT p_partkey, floor((p_retailprice * 1.5 - 10) * 100 + 0.5) / 100 AS v FROM part")
def x_chain(t):
    spec = X.serialize_transform(X.parse_transform("multiply:1.5|subtract:10|round:2"))
    return t.part.select("p_partkey", X.apply_chain(F.col("p_retailprice"), spec).cast("double").alias("v"))


@query("x_normalize_names", r"""SELECT s_suppkey, regexp_replace(regexp_replace(trim(lower(s_name)), '[^\w\s]', '', 'g'), '\s+', ' ', 'g') AS name, replace(lower(trim(s_name)), ' ', '_') AS id FROM supplier""")
def x_names(t):
    return t.supplier.select("s_suppkey", T.normalize_name(F.col("s_name")).alias("name"), T.normalize_id(F.col("s_name")).alias("id"))


@query("x_estimate_tokens", "SELECT doc_id, CAST(floor(octet_length(encode(text)) / 4) AS BIGINT) AS tokens FROM documents")
def x_tokens(t):
    return t.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("x_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON abs(length(a.n_name) - length(b.n_name)) <= 3 AND a.n_name < b.n_name WHERE levenshtein(a.n_name, b.n_name) <= 3")
def x_lev(t):
    n = t.nation
    a = n.select(F.col("n_name").alias("a"), F.explode(F.sequence(F.length("n_name") - 3, F.length("n_name") + 3)).alias("len"))
    b = n.select(F.col("n_name").alias("b"), F.length("n_name").alias("len"))
    return a.join(b, "len").where(F.col("a") < F.col("b")).withColumn("d", F.levenshtein("a", "b", 3).cast("long")).where("d >= 0").select("a", "b", "d")


@query("x_splitters", r"""SELECT doc_id,
  len(list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-Z0-9_\s''-]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS words,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS sentences,
  len(list_filter(regexp_split_to_array(text, '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS paragraphs
FROM documents""")
def x_split(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.size(T.words(c)).cast("long").alias("words"), F.size(T.sentences(c)).cast("long").alias("sentences"), F.size(T.paragraphs(c)).cast("long").alias("paragraphs"))


@query("x_syllables", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
c AS (SELECT word, regexp_replace(regexp_replace(word, '([^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '') AS cut FROM w)
SELECT word, CASE WHEN length(word) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(cut, '[aeiouy]{1,2}')), 1) END AS n FROM c""")
def x_syll(t):
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", T.syllables(F.col("word")).cast("long").alias("n"))


_SENT = r"""s AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS sent FROM documents),
l AS (SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(sent, '[^a-zA-Z0-9_\s''-]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS n FROM s)"""


@query("x_sentence_buckets", f"""WITH {_SENT}
SELECT doc_id, CASE WHEN n = 1 THEN 'one' WHEN n <= 6 THEN 'short' WHEN n <= 15 THEN 'medium' WHEN n <= 25 THEN 'long' WHEN n <= 39 THEN 'longer' ELSE 'longest' END AS bucket, count(*) AS n
FROM l GROUP BY 1, 2""")
def x_buckets(t):
    s = t.documents.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).withColumn("k", F.size(T.words(F.col("s"))))
    return s.groupBy("doc_id", T.length_bucket(F.col("k")).alias("bucket")).agg(F.count("*").alias("n"))


@query("x_variety_and_deviation", f"""WITH {_SENT},
b AS (SELECT doc_id, CASE WHEN n = 1 THEN 'one' WHEN n <= 6 THEN 'short' WHEN n <= 15 THEN 'medium' WHEN n <= 25 THEN 'long' WHEN n <= 39 THEN 'longer' ELSE 'longest' END AS bucket, count(*) AS c FROM l GROUP BY 1, 2),
v AS (SELECT doc_id, count(*) AS k, -sum((c / t) * log2(c / t)) AS e FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS t FROM b) GROUP BY 1),
d AS (SELECT doc_id, stddev_pop(n) AS sd FROM l GROUP BY 1)
SELECT doc_id, round(CASE WHEN k <= 1 THEN 0 ELSE 100 * e / log2(k) END, 4) AS variety, round(sd, 4) AS deviation FROM v JOIN d USING (doc_id)""")
def x_variety(t):
    s = t.documents.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).withColumn("k", F.size(T.words(F.col("s"))))
    b = s.groupBy("doc_id", T.length_bucket(F.col("k")).alias("bucket")).agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.collect_list("c").alias("cs"))
    d = s.groupBy("doc_id").agg(F.round(F.stddev_pop("k"), 4).alias("deviation"))
    return b.select("doc_id", F.round(T.variety_score(F.col("cs")), 4).alias("variety")).join(d, "doc_id")


@query("x_flow_insights", rf"""WITH s AS (SELECT row_number() OVER () AS r, doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''),
  lambda x: len(list_filter(regexp_split_to_array(regexp_replace(x, '[^a-zA-Z0-9_\s''-]', ' ', 'g'), '\s+'), lambda w: w <> ''))) AS k FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, [len(list_filter(k, lambda n: n = 1)), len(list_filter(k, lambda n: n <> 1 AND n <= 6)), len(list_filter(k, lambda n: n BETWEEN 7 AND 15)), len(list_filter(k, lambda n: n BETWEEN 16 AND 25)), len(list_filter(k, lambda n: n BETWEEN 26 AND 39)), len(list_filter(k, lambda n: n >= 40))] AS c,
  array_to_string([CASE WHEN abs(k[i + 1] - k[i]) <= 3 THEN '1' ELSE '0' END FOR i IN range(1, len(k))], '') AS near FROM s)
SELECT doc_id, CASE WHEN len(k) > 0 THEN ['one', 'short', 'medium', 'long', 'longer', 'longest'][list_position(c, list_max(c))] END AS dominant_range, coalesce(contains(near, '1111'), false) AS has_monotony,
  CAST(coalesce(list_sum([greatest(length(x) - 1, 0) FOR x IN regexp_extract_all(near, '1+')]), 0) AS BIGINT) AS consecutive_patterns FROM b""")
def x_flow(t):
    lengths = F.transform(T.sentences(F.col("text")), lambda s: F.size(T.words(s)))
    flow = T.flow_insights(F.col("k"))
    rows = t.documents.where("text IS NOT NULL").select("doc_id", lengths.alias("k")).select("doc_id", flow.alias("f"))
    return rows.select("doc_id", "f.dominant_range", "f.has_monotony", F.col("f.consecutive_patterns").cast("long").alias("consecutive_patterns"))


@query("x_consecutive_runs", """WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity, abs(l_quantity - lag(l_quantity) OVER w) <= 10 AS near, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity)),
g AS (SELECT *, sum(CASE WHEN coalesce(near, false) THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS island FROM o),
r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey, island ORDER BY l_linenumber, l_quantity) AS place FROM g)
SELECT l_orderkey, count(*) FILTER (place >= 3) AS n FROM r GROUP BY 1""")
def x_runs(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    return rows.select("l_orderkey", T.consecutive_runs(F.transform("v", lambda x: x["l_quantity"].cast("int")), 10).cast("long").alias("n"))


@query("x_reading_level", f"""WITH {_SENT},
c AS (SELECT doc_id, count(*) AS sentences, sum(n) AS words FROM l GROUP BY 1),
y AS (SELECT doc_id, sum(CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(regexp_replace(regexp_replace(w, '([^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{{1,2}}')), 1) END) AS syllables
  FROM (SELECT doc_id, lower(unnest(list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-Z0-9_\\s''-]', ' ', 'g'), '\\s+'), lambda x: x <> ''))) AS w FROM documents) GROUP BY 1)
SELECT doc_id, round(0.39 * words / sentences + 11.8 * syllables / words - 15.59, 4) AS grade,
  CASE WHEN 0.39 * words / sentences + 11.8 * syllables / words - 15.59 < 1 THEN 'Kindergarten' WHEN 0.39 * words / sentences + 11.8 * syllables / words - 15.59 < 6 THEN '1st-5th Grade' WHEN 0.39 * words / sentences + 11.8 * syllables / words - 15.59 < 9 THEN '6th-8th Grade' WHEN 0.39 * words / sentences + 11.8 * syllables / words - 15.59 < 13 THEN '9th-12th Grade' WHEN 0.39 * words / sentences + 11.8 * syllables / words - 15.59 < 17 THEN 'College Level' ELSE 'Graduate Level' END AS level,
  CAST(ceil(words / 225.0) AS BIGINT) AS reading_minutes, CAST(ceil(words / 150.0) AS BIGINT) AS speaking_minutes
FROM c JOIN y USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM documents)""")
def x_level(t):
    en = t.documents
    s = en.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.size(T.words(F.col("s")))).alias("words"))
    y = en.select("doc_id", F.explode(T.words(F.col("text"))).alias("w")).groupBy("doc_id").agg(F.sum(T.syllables(F.col("w"))).alias("syllables"))
    g = T.reading_grade(F.col("words"), F.col("sentences"), F.col("syllables"))
    return s.join(y, "doc_id").select("doc_id", F.round(g, 4).alias("grade"), T.reading_level(g).alias("level"), T.minutes(F.col("words"), 225).alias("reading_minutes"), T.minutes(F.col("words"), 150).alias("speaking_minutes"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("x_keyword_density", rf"""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-Z0-9_\s''-]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS word FROM documents),
k AS (SELECT regexp_replace(lower(word), '[^a-z''-]', '', 'g') AS kw FROM w)
SELECT kw AS word, count(*) AS n, floor(count(*) * 1000.0 / (SELECT count(*) FROM w) + 0.5) / 10 AS pct FROM k WHERE length(kw) >= 4 AND kw NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, word LIMIT 100""")
def x_keywords(t):
    w = t.documents.select(F.explode(T.words(F.col("text"))).alias("w")).withColumn("word", T.keyword(F.col("w")))
    per = w.groupBy("word").agg(F.count("*").alias("n"))
    total = F.broadcast(per.agg(F.sum("n").alias("all")))
    return per.where("word is not null").crossJoin(total).select("word", "n", X.round_half_up(F.col("n") * 100 / F.col("all"), 1).alias("pct")).orderBy(F.desc("n"), "word").limit(100)


CAL = C.Calendar(
    months=(C.Month("Flob", 30), C.Month("Bork", 28, 4, 1, 100), C.Month("Zam", 31)), weekdays=("A", "B", "C", "D", "E"),
    eras=(C.Era("First Age", "FA", 1, 1994), C.Era("Second Age", "SA", 1995)), moons={"Big": (29.5, 0.25)})
_Y, _M, _D = "CAST(year(o_orderdate) AS BIGINT)", "CAST((month(o_orderdate) - 1) % 3 AS BIGINT)", "CAST(day(o_orderdate) - 1 AS BIGINT)"
_BORK = "CASE WHEN y % 4 = 0 AND y % 100 <> 0 THEN 29 ELSE 28 END"


@query("x_calendar", f"""WITH d AS (SELECT o_orderkey, {_Y} AS y, {_M} AS m, {_D} AS d FROM orders),
e AS (SELECT *, 30 + {_BORK} + 31 AS year_days, CASE WHEN m > 0 THEN 30 ELSE 0 END + CASE WHEN m > 1 THEN {_BORK} ELSE 0 END + d AS doy, CASE WHEN m > 0 THEN 30 ELSE 0 END + CASE WHEN m > 1 THEN 28 ELSE 0 END + d AS flat FROM d)
SELECT o_orderkey, CAST(year_days AS BIGINT) AS year_days, CAST(doy % 5 AS BIGINT) AS weekday, round(flat / 29.5 + 0.25 - floor(flat / 29.5 + 0.25), 6) AS moon,
 y || ' ' || CASE WHEN y <= 1994 THEN 'FA' ELSE 'SA' END AS year_text,
 (d + 1) || ' ' || CASE m WHEN 0 THEN 'Flob' WHEN 1 THEN 'Bork' ELSE 'Zam' END || ', ' || y || ' ' || CASE WHEN y <= 1994 THEN 'FA' ELSE 'SA' END AS date_text,
 d < CASE m WHEN 0 THEN 30 WHEN 1 THEN {_BORK} ELSE 31 END AS valid FROM e""")
def x_calendar(t):
    d = t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), ((F.month("o_orderdate") - 1) % 3).cast("long").alias("m"), (F.dayofmonth("o_orderdate") - 1).cast("long").alias("d"))
    y, m, k = F.col("y"), F.col("m"), F.col("d")
    return d.select("o_orderkey", C.days_in_year(CAL, y).cast("long").alias("year_days"), C.weekday_index(CAL, y, m, k).cast("long").alias("weekday"), F.round(C.moon_phase(CAL, "Big", m, k), 6).alias("moon"), C.format_year(CAL, y).alias("year_text"), C.format_date(CAL, y, m.cast("int"), k).alias("date_text"), C.date_valid(CAL, y, m, k).alias("valid"))


@query("x_navigate_year", "SELECT n_nationkey, CASE WHEN n_nationkey - 10 + 1 = 0 THEN 1 ELSE n_nationkey - 10 + 1 END AS following, CASE WHEN n_nationkey - 10 - 1 = 0 THEN -1 ELSE n_nationkey - 10 - 1 END AS previous FROM nation")
def x_navigate(t):
    y = F.col("n_nationkey") - 10
    return t.nation.select("n_nationkey", C.navigate_year(y, 1, False).alias("following"), C.navigate_year(y, -1, False).alias("previous"))


@query("x_orbits", """SELECT p_partkey, round(2 * pi() * sqrt(pow(p_size * 0.1 * 1.496e11, 3) / (6.67430e-11 * 1.989e30 * (1 + p_size * 0.01))) / 86400, 4) AS days,
 round(sqrt(pow(1 + p_size * 0.01, 3.5)) * 0.95, 6) AS zone_min, CAST(CASE WHEN p_size * 20 < 100 THEN 5 WHEN p_size * 20 < 400 THEN 7 WHEN p_size * 20 < 600 THEN 8 ELSE 10 END AS BIGINT) AS week FROM part""")
def x_orbits(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", F.round(C.year_length(1 + s * 0.01, s * 0.1), 4).alias("days"), F.round(C.habitable_zone(1 + s * 0.01)["min"], 6).alias("zone_min"), C.week_length(s * 20).cast("long").alias("week"))


@query("x_datalog_scalars", "SELECT n_nationkey, n_name || ':' || CAST(n_nationkey AS VARCHAR) AS label, length(n_name) AS len, abs(n_nationkey - 12) AS a, least(n_nationkey, n_regionkey) AS lo, greatest(n_nationkey, n_regionkey) AS hi FROM nation")
def x_datalog(t):
    return t.nation.select("n_nationkey", F.concat_ws(":", "n_name", F.col("n_nationkey").cast("string")).alias("label"), F.length("n_name").cast("long").alias("len"), F.abs(F.col("n_nationkey") - 12).alias("a"), F.least("n_nationkey", "n_regionkey").alias("lo"), F.greatest("n_nationkey", "n_regionkey").alias("hi"))


@query("b_snippet", "SELECT doc_id, instr(lower(text), 'ther') > 0 AS hit FROM documents")
def b_snippet(t):
    return t.documents.select("doc_id", F.contains(T.snippet(F.col("text"), "ther"), F.lit("<b>")).alias("hit"))
