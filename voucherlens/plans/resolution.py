"""Queries of names, authorities, JSON records, label boxes and collectors' spellings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlens.functions import jsontext, text
from voucherlens.operators import boxes, collectors, names
from voucherlens.plans.catalog import query
from voucherlens.plans.specimens import table


def _binomial(c: str = "p_name") -> Column:
    return text.strip_authors(F.col(c))


_MISREAD = """WITH w AS (SELECT p_partkey AS k, lower(split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2)) AS b FROM part), known AS (SELECT DISTINCT b FROM w),
q AS (SELECT k, CASE k % 4 WHEN 0 THEN substr(b, 1, 2) || substr(b, 4) WHEN 1 THEN substr(b, 1, 1) || 'q' || substr(b, 3) WHEN 2 THEN substr(b, 1, 4) || 'z' || substr(b, 5) ELSE substr(b, 1, 2) || substr(b, 4) || 'yyy' END AS found FROM w),"""


@query(_MISREAD + """ m AS (SELECT f.found, known.b, levenshtein(f.found, known.b) AS d FROM (SELECT DISTINCT found FROM q) f JOIN known ON levenshtein(f.found, known.b) <= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY found ORDER BY d, b) AS r FROM m), x AS (SELECT found, b, 1 - d / greatest(length(found), length(b))::DOUBLE AS s FROM n WHERE r = 1)
SELECT k AS p_partkey, q.found, x.b AS nearest_name, CASE WHEN b IS NULL THEN 'Not found in WFO — possible extraction error' WHEN s >= 0.98 THEN 'Closest WFO match: <i>' || b || '</i> (' || CAST(floor(s * 100) AS INTEGER) || '% similar) — relationship to the reference not verified'
WHEN s >= 0.6 THEN 'Closest WFO match: <i>' || b || '</i> (' || CAST(floor(s * 100) AS INTEGER) || '% similar)' ELSE 'No close match in WFO — possible OCR/extraction error' END AS nearest_note FROM q LEFT JOIN x ON q.found = x.found""")
def nearest_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread names against all known ones: one or two edits find a name, three only by chance."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey"), _binomial().alias("b"))
    b, k = F.col("b"), F.col("p_partkey") % 4
    dropped = F.concat(F.substring(b, 1, 2), F.substring(b, 4, 1000))
    found = F.when(k == 0, dropped).when(k == 1, F.concat(F.substring(b, 1, 1), F.lit("q"), F.substring(b, 3, 1000))).when(k == 2, F.concat(F.substring(b, 1, 4), F.lit("z"), F.substring(b, 5, 1000))).otherwise(F.concat(dropped, F.lit("yyy")))
    rows = names.with_nearest(part.select("p_partkey", found.alias("found")), "found", part.select(b.alias("name")))
    return rows.select("p_partkey", "found", "nearest_name", "nearest_note")


_USAGES = """p AS (SELECT p_partkey AS k, p_partkey // 4 AS b, p_partkey % 4 AS m, lower(split_part(p_name, ' ', 1)) AS g, lower(split_part(p_name, ' ', 2)) || p_partkey AS e FROM part),
pl AS (SELECT p.k, p.b, p.m, p.g || ' ' || p.e AS name, 'Plantae/' || p.b % 7 || '/' || p.g || '/' || p.e AS own, 'Plantae/' || p.b % 7 || '/' || o.g || '/' || o.e AS other FROM p LEFT JOIN p o ON o.b = p.b AND o.m = CASE WHEN p.m = 3 AND p.b % 5 = 0 THEN 2 WHEN p.m = 3 THEN 0 WHEN p.m = 2 AND p.b % 5 = 0 THEN 3 ELSE p.m - 1 END),
us AS (SELECT name, CASE WHEN m = 0 THEN own WHEN m = 3 AND b % 5 <> 0 THEN other || '/' || split_part(own, '/', 4) ELSE other || '$' || name END AS placement, b, m FROM pl)"""


def _usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, b, m, name, placement): in each block of four names an accepted one, its synonym, a synonym of that, and a variety; in some blocks the last two name each other."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("k"), F.floor(k / 4).alias("b"), (k % 4).alias("m"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("g"), F.concat(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), k.cast("string")).alias("e"))
    path = lambda g, e: F.concat_ws("/", F.lit("Plantae"), (F.col("b") % 7).cast("string"), g, e)
    circle = F.col("b") % 5 == 0
    p = p.withColumn("to", F.when((F.col("m") == 3) & circle, 2).when(F.col("m") == 3, 0).when((F.col("m") == 2) & circle, 3).otherwise(F.col("m") - 1))
    o = p.select("b", F.col("m").alias("to"), F.col("g").alias("og"), F.col("e").alias("oe"))
    rows = p.join(o, ["b", "to"], "left").withColumn("name", F.concat_ws(" ", "g", "e"))
    other = path(F.col("og"), F.col("oe"))
    placement = F.when(F.col("m") == 0, path(F.col("g"), F.col("e"))).when((F.col("m") == 3) & ~circle, F.concat_ws("/", other, "e")).otherwise(F.concat(other, F.lit("$"), "name"))
    return rows.select("k", "b", "m", "name", F.when(F.col("og").isNotNull() | (F.col("m") == 0), placement).alias("placement"))


_RESOLVED = "WITH RECURSIVE " + _USAGES + """, pd AS (SELECT name, split_part(placement, '$', 1) AS path, contains(placement, '$') AS is_synonym FROM us WHERE placement IS NOT NULL),
nx AS (SELECT *, lower(split_part(path, '/', -2) || ' ' || split_part(path, '/', -1)) AS accepted FROM pd), st AS (SELECT name, accepted AS nxt FROM nx WHERE is_synonym AND accepted <> name),
re(name, too, steps) AS (SELECT name, nxt, 1 FROM st UNION SELECT re.name, st.nxt, CASE WHEN steps < 5 THEN steps + 1 ELSE 5 END FROM re JOIN st ON st.name = re.too),
cy AS (SELECT DISTINCT name FROM re WHERE name = too), tg AS (SELECT re.name, min(re.too) AS target, min(steps) AS steps FROM re LEFT JOIN st ON st.name = re.too WHERE st.name IS NULL GROUP BY re.name
 UNION ALL SELECT re.name, min(re.too), NULL FROM re JOIN cy ON cy.name = re.too GROUP BY re.name),
rs AS (SELECT nx.name, CASE WHEN nx.is_synonym THEN coalesce(tg.target, nx.name) ELSE nx.accepted END AS accepted, coalesce(t.path, nx.path) AS path, nx.is_synonym, CASE WHEN tg.name IS NULL THEN 0 ELSE tg.steps END AS steps FROM nx LEFT JOIN tg ON tg.name = nx.name LEFT JOIN nx t ON t.name = coalesce(tg.target, nx.name))"""


@query(_RESOLVED + " SELECT name, accepted, path, is_synonym, CAST(steps AS BIGINT) AS steps FROM rs")
def accepted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of an authority with the accepted name its synonyms lead to, over several steps and through cycles."""
    return names.resolved(_usages(spark, sf_dir).select("name", "placement")).select("name", "accepted", "path", "is_synonym", "steps")


@query(_RESOLVED + """, ab AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS above FROM rs),
pr AS (SELECT l_orderkey, l_linenumber, t.name AS truth, f.name AS found FROM lineitem LEFT JOIN us t ON t.b = l_partkey // 4 AND t.m = l_partkey % 4 LEFT JOIN us f ON f.b = l_partkey // 4 AND f.m = l_linenumber % 4)
SELECT l_orderkey, l_linenumber, truth, found, CASE WHEN truth = found THEN NULL WHEN t.is_synonym AND found = t.accepted THEN 'WFO-rev' WHEN f.path = t.path OR f.above = t.path OR t.above = f.path THEN CASE WHEN t.is_synonym THEN 'WFO-sib' ELSE 'WFO' END END AS relation
FROM pr LEFT JOIN ab t ON t.name = truth LEFT JOIN ab f ON f.name = found""")
def authority_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True names against found ones of the same block: WFO-rev, WFO-sib, WFO or nothing."""
    own = _usages(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_partkey") / 4).alias("b"), (F.col("l_partkey") % 4).alias("tm"), (F.col("l_linenumber") % 4).cast("long").alias("fm"))
    side = lambda m, n: own.select("b", F.col("m").alias(m), F.col("name").alias(n))
    pairs = lines.join(side("tm", "truth"), ["b", "tm"], "left").join(side("fm", "found"), ["b", "fm"], "left").select("l_orderkey", "l_linenumber", "truth", "found")
    return names.authority_relation(pairs, own.select("name", "placement"))


@query(_RESOLVED + """, ab AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS above FROM rs)
SELECT a.name, count(b.name) AS n_relatives, min(b.name) AS first_relative FROM ab a LEFT JOIN ab b ON a.name <> b.name AND (a.path = b.path OR a.above = b.path OR b.above = a.path) GROUP BY a.name""")
def related_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other names each name's classification path relates it to."""
    usages = _usages(spark, sf_dir).select("name", "placement")
    found = names.relatives(usages).groupBy("name").agg(F.count(F.lit(1)).alias("n_relatives"), F.min("relative").alias("first_relative"))
    return usages.where("placement is not null").select("name").join(found, "name", "left").na.fill(0, ["n_relatives"])


_DOCUMENTS = r"""WITH d AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN '{"extensions": {"ids": [1, {"genus": "A' || o_orderkey || '"}]}, "genus": "B"}' WHEN 1 THEN '{"genus": null, "x": {"genus": "C' || o_orderkey || '"}}'
 WHEN 2 THEN '{"note": "\"genus\": \"no\", {", "genus": "D \"quoted\" ' || o_orderkey || '\\"}' WHEN 3 THEN '{"zz": {"genus": " "}, "aa": [[], [{"genus": 0}, {"genus": "E' || o_orderkey || '"}]]}' WHEN 4 THEN '{}' WHEN 6 THEN '{"genus": "été ' || o_orderkey || '\n"}' END AS fragment,
 CASE WHEN o_orderkey % 7 = 4 THEN '{"record": {"genus": "V' || o_orderkey || '"}}' ELSE '[{"genus": "n/a"}]' END AS verbatim, CASE WHEN o_orderkey % 3 = 0 THEN '{"genus": "O' || o_orderkey || '", "deep": {"genus": "P"}}' ELSE '{"deep": {"genus": "P"}}' END AS occurrence FROM orders)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, say = F.col("o_orderkey"), lambda a, b: F.concat(F.lit(a), F.col("o_orderkey").cast("string"), F.lit(b))
    fragment = F.when(o % 7 == 0, say('{"extensions": {"ids": [1, {"genus": "A', '"}]}, "genus": "B"}')).when(o % 7 == 1, say('{"genus": null, "x": {"genus": "C', '"}}'))
    fragment = fragment.when(o % 7 == 2, say(r'{"note": "\"genus\": \"no\", {", "genus": "D \"quoted\" ', r'\\"}')).when(o % 7 == 3, say('{"zz": {"genus": " "}, "aa": [[], [{"genus": 0}, {"genus": "E', '"}]]}'))
    fragment = fragment.when(o % 7 == 4, F.lit("{}")).when(o % 7 == 6, say(r'{"genus": "été ', r'\n"}'))
    verbatim = F.when(o % 7 == 4, say('{"record": {"genus": "V', '"}}')).otherwise(F.lit('[{"genus": "n/a"}]'))
    occurrence = F.when(o % 3 == 0, say('{"genus": "O', '", "deep": {"genus": "P"}}')).otherwise(F.lit('{"deep": {"genus": "P"}}'))
    return table(spark, sf_dir, "orders").select(o.alias("k"), fragment.alias("fragment"), verbatim.alias("verbatim"), occurrence.alias("occurrence"))


@query(_DOCUMENTS + r""", t AS (SELECT k, 1 AS s, j.id, j.type, j.atom FROM d, json_tree(d.fragment) j WHERE j.key = 'genus' UNION ALL SELECT k, 2, j.id, j.type, j.atom FROM d, json_tree(d.verbatim) j WHERE j.key = 'genus' UNION ALL SELECT k, 3, 0, 'VARCHAR', json_extract(d.occurrence, '$.genus') FROM d WHERE json_extract(d.occurrence, '$.genus') IS NOT NULL),
v AS (SELECT k, s, id, atom ->> '$' AS said FROM t WHERE type = 'VARCHAR' AND lower(trim(atom ->> '$')) NOT IN ('', 'n/a', 'nan', 'none')), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, id) AS n FROM v)
SELECT d.k AS o_orderkey, coalesce(r.said, 'N/A') AS genus FROM d LEFT JOIN r ON r.k = d.k AND r.n = 1""")
def deep_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of three JSON documents a record, at any depth, in the order of the text."""
    return _documents(spark, sf_dir).select(F.col("k").alias("o_orderkey"), jsontext.pick_value("genus", *map(F.col, ("fragment", "verbatim", "occurrence"))).alias("genus"))


@query("""WITH c AS (SELECT l_orderkey AS image, l_linenumber AS pos, l_partkey * 37 % 900 AS x, l_suppkey * 53 % 700 AS y, CAST(l_quantity AS BIGINT) * 14 AS w, l_partkey % 97 * 8 AS h FROM lineitem),
f AS (SELECT *, greatest(0, x - 12) AS x1, greatest(0, y - 12) AS y1, least(1000, x + w + 12) AS x2, least(800, y + h + 12) AS y2 FROM c WHERE w * h > 0.003 * 800000 AND w * h < 0.6 * 800000 AND h > 0 AND w / h::DOUBLE BETWEEN 0.1 AND 20)
SELECT image, pos, x1, y1, x2, y2, CAST(row_number() OVER (PARTITION BY image ORDER BY y1 // 100, x1, y1, x2, y2, pos) - 1 AS INTEGER) AS place FROM f""")
def label_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours that a label may have, with some room, in reading order."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") * 37 % 900).alias("x"), (F.col("l_suppkey") * 53 % 700).alias("y"), (F.col("l_quantity").cast("long") * 14).alias("w"), (F.col("l_partkey") % 97 * 8).alias("h"), F.lit(1000).cast("long").alias("width"), F.lit(800).cast("long").alias("height"))
    return boxes.reading_order(boxes.padded(boxes.label_like(rows))).select("image", "pos", "x1", "y1", "x2", "y2", "place")


@query()
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of one label made one box, within an image and class; tests hold it against the rule in order."""
    li = table(spark, sf_dir, "lineitem")
    cls = F.when(F.col("l_returnflag") == "R", "ruler").when(F.col("l_linestatus") == "F", "label").otherwise("barcode")
    x, y = F.col("l_partkey") * 37 % 300, F.col("l_suppkey") * 53 % 300
    rows = li.select(F.floor(F.col("l_orderkey") / 16).alias("image"), cls.alias("cls"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), x.alias("x1"), y.alias("y1"), (x + 40 + F.col("l_quantity").cast("long")).alias("x2"), (y + 30 + F.col("l_partkey") % 60).alias("y2"))
    return boxes.merge_boxes(boxes.text_boxes(rows))


_SPELT = """WITH o AS (SELECT o_orderkey AS k, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS s, chr(65 + CAST(o_orderkey // 8 % 3 AS INTEGER)) AS i, o_orderkey % 8 AS f, o_orderstatus AS c, year(CAST(o_orderdate AS DATE)) AS y FROM orders JOIN part ON p_partkey = 1 + o_custkey % 60),
n AS (SELECT DISTINCT s, i FROM o), h AS (SELECT lower(n.s) || '|' || lower(n.i) AS key, n.s, n.i, o.k, o.c, o.y FROM n JOIN o ON o.s = n.s AND (o.f = 4 OR (o.f IN (0, 1, 2, 5, 7) AND o.i = n.i)))"""


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, name, recordedBy, country, year): one person's name in eight spellings, two of them in lists and two that no common spelling is."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    rows = orders.join(part, F.col("p_partkey") == 1 + F.col("o_custkey") % 60)
    s = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring(F.split_part("p_name", F.lit(" "), F.lit(1)), 2, 100))
    i = F.char(65 + F.floor(F.col("o_orderkey") / 8) % 3)
    rows = rows.select(F.col("o_orderkey").alias("k"), s.alias("s"), i.alias("i"), F.col("o_orderstatus").alias("country"), F.year(F.col("o_orderdate").cast("date")).alias("year"))
    s, i, other = F.col("s"), F.col("i"), F.lit("X. Other")
    form = [F.concat(s, F.lit(", "), i, F.lit(".")), F.concat(i, F.lit(". "), s), F.concat(i, F.lit(" "), s), F.concat(F.upper(s), F.lit(", "), i, F.lit(".")), s, F.concat(s, F.lit(", "), i, F.lit(". | "), i, F.lit(". "), s), F.concat(s, F.lit(", "), i, F.lit(".; "), other), F.concat(other, F.lit("|"), s, F.lit(" "), i)]
    return rows.select("k", F.concat(s, F.lit(", "), i, F.lit(".")).alias("name"), F.get(F.array(*form), (F.col("k") % 8).cast("int")).alias("recordedBy"), "country", "year")


@query(_SPELT + """, cc AS (SELECT key, c, count(*) AS n FROM h GROUP BY key, c), tc AS (SELECT key, string_agg(c || ' ' || format('{:,}', n), ', ' ORDER BY n DESC, c) AS top FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, c) AS r FROM cc) WHERE r <= 4 GROUP BY key)
SELECT key, count(*) AS total, count(DISTINCT c) AS n_countries, count(DISTINCT y) AS n_years, any_value(top) AS top FROM h JOIN tc USING (key) GROUP BY key""")
def variant_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collectors' records under all common spellings of their names."""
    rows = _spelt(spark, sf_dir)
    found = collectors.variant_profiles(rows, rows)
    return found.where("total > 0").select("key", "total", F.size("countries").cast("long").alias("n_countries"), F.size("years").cast("long").alias("n_years"), collectors.top_countries(F.col("countries")).alias("top"))


@query(_SPELT + """, t AS (SELECT key, s, i, count(*) AS n FROM h GROUP BY key, s, i), cc AS (SELECT key, c, count(*) AS n FROM h GROUP BY key, c), cn AS (SELECT DISTINCT c FROM o),
q AS (SELECT o.k, o.s || ', ' || o.i || '.' AS collector, CASE WHEN o.k % 9 = 0 THEN 'Z' ELSE o.c END AS code, o.c AS own, t.key, t.n - (o.f IN (0, 1, 2, 4))::INT AS total, (o.f IN (0, 1, 2, 4))::INT AS less FROM o JOIN t ON t.s = o.s AND t.i = o.i),
x AS (SELECT q.*, coalesce(cc.n, 0) - CASE WHEN q.code = q.own THEN less ELSE 0 END AS in_country FROM q LEFT JOIN cc ON cc.key = q.key AND cc.c = q.code),
g AS (SELECT q.k, string_agg(cc.c || ' ' || format('{:,}', cc.n - CASE WHEN cc.c = q.own THEN less ELSE 0 END), ', ' ORDER BY cc.n - CASE WHEN cc.c = q.own THEN less ELSE 0 END DESC, cc.c) AS top FROM q JOIN cc ON cc.key = q.key WHERE cc.n - CASE WHEN cc.c = q.own THEN less ELSE 0 END > 0 GROUP BY q.k)
SELECT x.k, total, in_country, CASE WHEN total < 20 THEN 'unknown' WHEN in_country <= 0 THEN 'country' ELSE 'ok' END AS verdict, CASE WHEN total >= 20 THEN CASE WHEN in_country <= 0 THEN 'warn' ELSE 'ok' END END AS kind,
CASE WHEN total >= 20 AND in_country <= 0 THEN 'GBIF has ' || format('{:,}', total) || ' preserved specimens by ''' || collector || ''', none from country ' || code || ' (' || code || '). Most are from: ' || coalesce(top, 'none') || '. A hint to check the collector and country, not a correction.'
WHEN total >= 20 THEN 'GBIF has ' || format('{:,}', in_country) || ' of ' || format('{:,}', total) || ' preserved specimens by ''' || collector || ''' from country ' || code || ' (' || code || ').' END AS detail FROM x LEFT JOIN g ON g.k = x.k""")
def collector_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to say of each record's collector and country, the record itself left out of the evidence."""
    rows = _spelt(spark, sf_dir)
    code = F.when(F.col("k") % 9 == 0, "Z").otherwise(F.col("country"))
    records = rows.select("k", F.col("name").alias("collector"), code.alias("country_code"), F.concat(F.lit("country "), code).alias("country"), F.lit(None).cast("int").alias("year"), F.col("recordedBy").alias("own_recordedBy"), F.col("country").alias("own_country"), F.col("year").alias("own_year"))
    found = collectors.flags(collectors.judged(records, collectors.variant_profiles(rows, rows)))
    return found.select("k", "total", "in_country", "verdict", "flag.kind", "flag.detail")
