"""Names against names: the nearest known name within some edits, and the place of names in an authority's classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.functions import text
from voucherlens.sources.shared import discard, written

# The wording of notes on a name that nothing relates to the truth.
NOT_FOUND = "Not found in WFO — possible extraction error"
NOT_CLOSE = "No close match in WFO — possible OCR/extraction error"


def deletions(name: Column, edits: int) -> Column:
    """All texts that `name` becomes by leaving out up to `edits` characters: two names within `edits` edits share one."""
    without = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    levels = [F.array(name)]
    for _ in range(edits):
        # each level is worked out once: `let` names it for the next
        levels.append(text.let(levels[-1], lambda these: F.array_distinct(F.flatten(F.transform(these, without)))))
    return F.array_distinct(F.concat(*levels))


def nearest_names(names: DataFrame, known: DataFrame, edits: int = 2, often: int = 1000) -> DataFrame:
    """(name, nearest, distance, similarity) for distinct non-null `name`s with a `known` name within `edits` edits.

    The nearest is the known name of fewest edits, the first in order on a tie; similarity is 1 - edits / longer length.
    Each name stands for its deletion neighbourhood, so names meet by equality of hashes and `levenshtein` decides; no
    name is compared with all others. A neighbourhood text that more than `often` known names share (that of short
    names) is dealt out over so many shares that each holds about `often`. Either table may be empty.
    """
    if not 0 <= edits <= 3:
        raise ValueError("edits must be 0 to 3: neighbourhoods grow with the length to that power")
    spread = lambda df: df.where("name is not null").distinct().select("name", F.explode(deletions(F.col("name"), edits)).alias("part")).select("name", F.xxhash64("part").alias("key"))
    ours, theirs = spread(names.select("name")), spread(known.select(F.col("name")))
    hot = theirs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / often).cast("int").alias("shares")).where("shares > 1")
    theirs = theirs.join(hot, "key", "left").select("key", F.col("name").alias("nearest"), F.pmod(F.xxhash64("name"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    ours = ours.join(hot, "key", "left").select("key", "name", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    met = ours.join(theirs, ["key", "share"]).where(F.abs(F.length("name") - F.length("nearest")) <= edits).select("name", "nearest").distinct()
    met = met.withColumn("distance", F.levenshtein("name", "nearest")).where(F.col("distance") <= edits)
    best = met.groupBy("name").agg(F.min(F.struct("distance", "nearest")).alias("b")).select("name", "b.nearest", "b.distance")
    return best.withColumn("similarity", 1 - F.col("distance") / F.greatest(F.length("name"), F.length("nearest"), F.lit(1)))


def nearest_note(nearest: Column, similarity: Column, source: str = "WFO") -> Column:
    """The note on a found name that isn't related to the truth: the closest known name, and how close."""
    close = F.format_string(f"Closest {source} match: <i>%s</i> (%d%% similar)", nearest, F.floor(similarity * 100).cast("int"))
    unsure = F.concat(close, F.lit(" — relationship to the reference not verified"))
    return F.when(nearest.isNull(), NOT_FOUND).when(similarity >= 0.98, unsure).when(similarity >= 0.6, close).otherwise(NOT_CLOSE)


def with_nearest(df: DataFrame, name_col: str, known: DataFrame, edits: int = 2, source: str = "WFO") -> DataFrame:
    """`df` with nearest_name, nearest_similarity and nearest_note of a name column; looked up once for each distinct name of two words.

    `known`: name, as `strip_authors` leaves it.
    """
    clean = text.strip_authors(F.col(name_col))
    asked = df.select(clean.alias("name")).where(F.col("name").contains(" ")).distinct()
    found = nearest_names(asked, known, edits).select(F.col("name").alias("asked_name"), F.col("nearest").alias("nearest_name"), F.col("similarity").alias("nearest_similarity"))
    out = df.withColumn("own_name", clean).join(found, F.col("own_name") == F.col("asked_name"), "left").drop("own_name", "asked_name")
    return out.withColumn("nearest_note", nearest_note(F.col("nearest_name"), F.col("nearest_similarity"), source))


def placed(usages: DataFrame) -> DataFrame:
    """(name, path, accepted, is_synonym) of an authority's (name, placement) rows: the accepted path and its binomial.

    A placement is a classification path with "/" between ranks; behind a "$" follows the synonym itself. Rows whose path
    has fewer than two ranks are left out; of several placements of one name the first in order stays.
    """
    path = F.substring_index("placement", "$", 1)
    ranks = F.filter(F.split(path, "/"), lambda s: s != "")
    last = text.transliterate(F.lower(F.array_join(F.slice(ranks, F.size(ranks) - 1, F.lit(2)), " ")))
    rows = usages.where("name is not null and placement is not null").groupBy("name").agg(F.min("placement").alias("placement"))
    rows = rows.where(F.size(ranks) >= 2)
    return rows.select("name", path.alias("path"), last.alias("accepted"), F.col("placement").contains("$").alias("is_synonym"))


def followed(pointers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(name, target, steps, in_cycle) of (name, next): where each name's chain of nexts ends, by pointer jumping.

    A round doubles how far every pointer reaches, so a chain of n steps takes log n joins. A name without a next is its
    own target. A chain that runs into a cycle has the cycle's first name as its target, and no number of steps. Names
    are distinct; a next that is no name of the table ends a chain.
    """
    rows = pointers.where("name is not null").select("name", F.nullif("next", F.col("name")).alias("next"))
    known = rows.select(F.col("name").alias("next"), F.lit(True).alias("goes_on"))
    # `least` is the first in order of the names stepped on
    now = rows.join(known, "next", "left").select("name", F.coalesce("next", "name").alias("at"), F.col("next").isNotNull().cast("long").alias("steps"), F.coalesce("next", "name").alias("least"), (F.col("next").isNotNull() & F.col("goes_on").isNotNull()).alias("open"))
    now = written(now, "pointers")
    size = now.count()
    reach = 1
    while reach < 2 * size and reach < 1 << max_rounds:
        if now.where("open").isEmpty():
            break
        ahead = now.select(F.col("name").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("open").alias("open2"))
        step = now.where("open").join(ahead, "at").select("name", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), F.col("open2").alias("open"))
        new = written(now.where("not open").unionByName(step), "pointers")
        discard(now)
        now, reach = new, 2 * reach
    # what is still open has gone round a cycle: its place is on the cycle, and what it stepped on from there is all of it
    cycles = now.where("open").select(F.col("name").alias("at"), F.col("least").alias("first"))
    ends = now.join(cycles, "at", "left")
    return ends.select("name", F.when(F.col("open"), F.col("first")).otherwise(F.col("at")).alias("target"), F.when(~F.col("open"), F.col("steps")).alias("steps"), F.col("open").alias("in_cycle"))


def resolved(usages: DataFrame) -> DataFrame:
    """(name, accepted, path, is_synonym, steps): names with their accepted name followed to its end.

    An accepted name that is itself a synonym leads on; the path is that of the last name that the authority places.
    Names in a cycle of synonyms resolve to its first name.
    """
    own = written(placed(usages), "placed")
    ends = followed(own.select("name", F.when(F.col("is_synonym"), F.col("accepted")).alias("next")))
    paths = own.select(F.col("name").alias("target"), F.col("path").alias("target_path"))
    rows = own.join(ends, "name").join(paths, "target", "left")
    # a target that the authority has no row for is placed by the synonym that names it
    return rows.select("name", F.when(F.col("is_synonym"), F.col("target")).otherwise(F.col("accepted")).alias("accepted"), F.coalesce("target_path", "path").alias("path"), "is_synonym", "steps")


def related(a: Column, b: Column) -> Column:
    """Two classification paths are equal, or one is the other and one rank more."""
    above = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    return (a == b) | ((above(a) == b) & a.contains("/")) | ((above(b) == a) & b.contains("/"))


def authority_relation(pairs: DataFrame, usages: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """`pairs` with `relation`: WFO-rev, WFO-sib, WFO or null, as an authority relates the true name to the found one.

    The truth must be known. WFO-rev: it is a synonym and the found name its accepted one. Else the found name must be
    known as well, with a related path: WFO-sib where the truth is a synonym, WFO where it is accepted. Distinct names
    are looked up once; equal names have no relation.
    """
    names = resolved(usages)
    t = names.select(F.col("name").alias("t_name"), F.col("accepted").alias("t_accepted"), F.col("path").alias("t_path"), F.col("is_synonym").alias("t_synonym"))
    f = names.select(F.col("name").alias("f_name"), F.col("path").alias("f_path"))
    clean = pairs.withColumn("t_clean", text.strip_authors(F.col(truth))).withColumn("f_clean", text.strip_authors(F.col(found)))
    rows = clean.join(t, F.col("t_clean") == F.col("t_name"), "left").join(f, F.col("f_clean") == F.col("f_name"), "left")
    note = F.when(F.col("t_clean") == F.col("f_clean"), None).when(F.col("t_synonym") & (F.col("f_clean") == F.col("t_accepted")), "WFO-rev")
    note = note.when(related(F.col("f_path"), F.col("t_path")), F.when(F.col("t_synonym"), "WFO-sib").otherwise("WFO"))
    return rows.select(*pairs.columns, note.alias("relation"))


def relatives(usages: DataFrame) -> DataFrame:
    """(name, relative) of distinct names whose accepted paths are related: each path also stands under its parent, so paths meet by equality."""
    names = written(resolved(usages).select("name", "path"), "paths")
    above = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    down = names.select("name", above.alias("path")).where("path is not null")
    pair = lambda a, b: a.join(b.select(F.col("name").alias("relative"), "path"), "path").select("name", "relative")
    rows = pair(names, names).unionAll(pair(down, names)).unionAll(pair(names, down))
    return rows.where("name <> relative").distinct()


def taxonomic_status(name: Column, checklist: Column, backbone: Column) -> Column:
    """struct(status, accepted, source): the checklist's verdict on a name, else the backbone's, else "not found".

    `checklist`: struct(status, accepted); `backbone`: struct(status, accepted). A missing name has empty texts.
    """
    say = lambda s, a, by: F.struct(F.lit(s).alias("status"), a.alias("accepted"), F.lit(by).alias("source"))
    empty, clean = F.lit(""), text.strip_authors(name)
    by_list, by_spine = F.lower(checklist["status"]), F.upper(backbone["status"])
    accepted = text.strip_authors(checklist["accepted"])
    out = F.when(F.lower(F.trim(F.coalesce(name, empty))).isin(text.VALID_NULLS), say("", empty, ""))
    out = out.when(by_list.isin("accepted", "provisionally accepted"), say("accepted", clean, "WFO")).when(by_list.contains("synonym") & (accepted != ""), say("synonym", accepted, "WFO"))
    out = out.when(by_spine == "ACCEPTED", say("accepted", F.coalesce(F.nullif(backbone["accepted"], empty), clean), "GBIF"))
    return out.when(by_spine == "SYNONYM", say("synonym", F.coalesce(backbone["accepted"], empty), "GBIF")).otherwise(say("not found", empty, ""))
