"""The catalogue of materials: meanings, classes and draws, as joins.

``mappings``: semantic, family, priority, allowed (array of classes), is_default.
``stock``: material_idx, family, level, kind, selectable, tag, alphas (array by band).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlake.functions.text import normalized
from roomlake.operators import sampling
from roomlake.storage import Workspace

#: Classes of absorption in their order, and the words that stand for them or for any.
CLASSES = ("reflective", "semi_reflective", "absorptive", "highly_absorptive")
CLASS_WORDS = {"": "auto", "auto": "auto", "random": "auto", "reflective": "reflective", "low": "reflective", "semi_reflective": "semi_reflective", "semi": "semi_reflective", "medium_low": "semi_reflective", "absorptive": "absorptive", "medium": "absorptive", "high": "highly_absorptive", "highly_absorptive": "highly_absorptive"}
#: Families that everyday words stand for.
FAMILY_WORDS = {"wood": "wood_panel", "glass": "glass_reflective", "metal": "metal_reflective", "plastic": "plastic_vinyl_reflective", "fabric": "fabric_textile_absorber", "carpet": "carpet_floor_absorber"}
#: What surfaces let through (dB) from 125 Hz to 4 kHz, and the surfaces of a room with their meanings.
LOSSES = {"wall": (38, 42, 46, 50, 52, 54), "floor": (42, 46, 50, 54, 56, 58), "ceiling": (35, 39, 43, 47, 49, 51), "window": (22, 25, 28, 31, 33, 35), "window_glass": (22, 25, 28, 31, 33, 35), "door": (20, 23, 26, 29, 31, 33), "curtain": (6, 8, 10, 12, 14, 16), "curtain_blind": (6, 8, 10, 12, 14, 16)}
LOSS_OTHER = (30, 33, 36, 39, 41, 43)
#: Where the classes of mean absorption at 500 Hz to 2 kHz begin.
CLASS_FROM = (0.10, 0.30, 0.60)
SURFACE = "surface_absorption_coefficient"
#: Absorption where nothing is known of a surface, and its scattering.
FALLBACK = {"wall": 0.06, "floor": 0.10, "ceiling": 0.08, "door": 0.14, "carpet": 0.45, "carpet_rug": 0.45, "curtain": 0.45, "curtain_blind": 0.45, "sofa": 0.55, "sofa_couch": 0.55, "window": 0.08, "window_glass": 0.08}
FALLBACK_OTHER, FALLBACK_SCATTERING = 0.20, 0.12
#: Requests of equal terms in a row, requests and materials of a block of a term's pairs, and pairs of a task, on average; tasks at most.
REQUESTS_A_ROW, BLOCK, PAIRS_A_TASK, TASKS = 512, 2048, 2_000_000, 100_000


def middle_absorption(alphas: Column) -> Column:
    """Mean at 500, 1000 and 2000 Hz."""
    return (alphas[2] + alphas[3] + alphas[4]) / 3


def absorption_class(alphas: Column) -> Column:
    mid = middle_absorption(alphas)
    return F.when(mid < CLASS_FROM[0], CLASSES[0]).when(mid < CLASS_FROM[1], CLASSES[1]).when(mid < CLASS_FROM[2], CLASSES[2]).otherwise(CLASSES[3])


def canonical(semantic: Column, aliases: Mapping[str, str]) -> Column:
    """The meaning that an alias stands for, else the name itself."""
    name = F.translate(F.lower(F.trim(semantic)), "- ", "__")
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)


def fallback_absorption(semantic: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FALLBACK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, semantic), F.lit(FALLBACK_OTHER))


def surface_rows(stock: DataFrame, *, equivalent_area: bool = False) -> DataFrame:
    kind = F.lit(True) if equivalent_area else F.coalesce(F.col("kind"), F.lit(SURFACE)) == SURFACE
    return stock.where(F.coalesce("selectable", F.lit(True)) & kind)


def eligible(mappings: DataFrame, stock: DataFrame, tags: Mapping[str, list[str]], *, equivalent_area: bool = False) -> DataFrame:
    """Each mapping with the materials it allows; of a (semantic, family, class) those tagged for the semantic, if any are."""
    joined = mappings.join(surface_rows(stock, equivalent_area=equivalent_area), "family").where(F.array_contains("allowed", F.col("level")))
    table = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]) if tags else F.create_map().cast("map<string,array<string>>")
    wanted = F.coalesce(F.array_contains(F.try_element_at(table, F.col("semantic")), F.col("tag")), F.lit(False))
    marked = joined.withColumn("_w", wanted)
    return marked.withColumn("_any", F.max("_w").over(Window.partitionBy("semantic", "family", "level"))).where("_w OR NOT _any").drop("_w", "_any")


def catalog(mappings: DataFrame, stock: DataFrame) -> DataFrame:
    """semantic, classes that can be had, default family (else that of the first priority)."""
    found = eligible(mappings, stock, {}).groupBy("semantic").agg(F.array_sort(F.collect_set("level")).alias("classes"))
    default = mappings.groupBy("semantic").agg(F.min(F.struct((~F.col("is_default")).alias("no"), "priority", "family"))["family"].alias("default_family"))
    return default.join(found, "semantic", "left")


def draw(requests: DataFrame, mappings: DataFrame, stock: DataFrame, tags: Mapping[str, list[str]], *, seed: int) -> DataFrame:
    """A material for each request (request_id, semantic, asked: a class or "auto").

    On "auto" the default mapping serves, else the first by priority, with all
    classes it allows. For a class, mappings are drawn by 1 / priority among those
    that have it, or have the class nearest to it; then a row of the mapping. What
    no mapping serves gets null and its fallback absorption.
    """
    rows = eligible(mappings, stock, tags).select("semantic", "family", "priority", "is_default", "level", "material_idx")
    # one row a (semantic, family, level) is drawn before the requests are met
    per = sampling.weighted_draw(rows, ["semantic", "family", "level"], weight=F.lit(1.0), index="material_idx", seed=seed)
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in CLASSES]), c)
    met = requests.join(per, "semantic", "left").withColumn("_auto", F.col("asked") == "auto")
    apart = F.when(F.col("_auto"), 0).otherwise(F.abs(place(F.col("level")) - place(F.col("asked"))))
    u = (sampling.arithmetic_hash(F.col("request_id") * 31 + F.coalesce(F.col("priority"), F.lit(0)), seed) + 1) / F.lit(float(sampling.PRIME + 1))
    lot = F.when(F.col("_auto"), F.when(F.col("is_default"), 0.0).otherwise(F.col("priority").cast("double"))).otherwise(F.round(-F.log(u) * F.greatest(F.col("priority"), F.lit(1)), 9))
    order = Window.partitionBy("request_id").orderBy(apart, place(F.col("level")) * F.when(F.col("_auto"), 0).otherwise(1), lot, "family", F.abs(place(F.col("level")) - 2), "material_idx")
    first = met.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    changed = ~F.col("_auto") & (F.col("level") != F.col("asked"))
    return first.select("request_id", "semantic", "asked", "family", "level", "material_idx", F.when(changed, F.col("asked")).alias("fallback_from"), F.when(F.col("material_idx").isNull(), fallback_absorption(F.col("semantic"))).alias("fallback_alpha"))


def _word(table: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def absorption_word(level: Column, *, strict: bool = True) -> Column:
    """The class that a word stands for, "auto" for null; an unknown word is an error, or null unless ``strict``."""
    found = F.when(level.isNull(), "auto").otherwise(_word(CLASS_WORDS, normalized(level)))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown absorption class: "), level)).cast("string")).otherwise(found) if strict else found


def family_word(name: Column) -> Column:
    """The family that an everyday word stands for, else the word itself."""
    return F.coalesce(_word(FAMILY_WORDS, normalized(name)), normalized(name))


def transmission_loss(semantic: Column) -> Column:
    """Decibels by band that a surface of a meaning holds back, where no material says so."""
    bands = lambda row: F.array(*[F.lit(float(v)) for v in row])
    table = F.create_map(*[x for k, row in LOSSES.items() for x in (F.lit(k), bands(row))])
    return F.coalesce(F.try_element_at(table, F.lower(semantic)), bands(LOSS_OTHER))


def terms_of(semantic: Column, canonical_name: Column, vocabulary: Column, aliases: Column) -> Column:
    """All names of a meaning, in lower case and once each."""
    own = F.concat(F.array(semantic, canonical_name, vocabulary), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(own, lambda t: F.lower(t)), lambda t: t.isNotNull() & (t != "")))


def candidates(stock: DataFrame, wishes: DataFrame, names: Sequence[str], aliases: str) -> DataFrame:
    """request_id, material_idx of the materials that have one of a wish's ``terms`` as a name, each pair once.

    A term of many wishes and many materials gives all their pairs. So wishes of the
    same terms are looked up together, a pair comes from the first term that it has in
    common, which leaves nothing to tell apart afterwards, and a term's pairs are dealt
    in blocks to a number of tasks said outright. Only rows of blocks are shuffled.
    """
    space = Workspace(stock.sparkSession, "candidates")
    own = F.concat(F.array(*[F.lower(F.col(n)) for n in names]), F.transform(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda t: F.lower(t)))

    def listed(rows: DataFrame, key: str, terms: Column) -> DataFrame:
        each = rows.select(key, F.explode(F.array_distinct(terms)).alias("term")).where("term is not null")
        return each.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"))

    named = space.save(listed(stock, "material_idx", own), "named")
    asked = space.save(listed(wishes, "request_id", F.col("terms")), "asked")
    alike = space.save(asked.groupBy("terms").agg(F.ceil(F.count("*") / REQUESTS_A_ROW).cast("int").alias("rows")), "alike")
    dealt = asked.join(alike, "terms").withColumn("row", F.pmod(F.xxhash64("request_id"), F.col("rows")).cast("int"))
    together = space.save(dealt.groupBy("terms", "row").agg(F.collect_list(F.struct("request_id")).alias("requests")), "together")

    wanting = together.select(F.explode("terms").alias("term"), F.col("terms").alias("wanted"), "row", "requests")
    having = named.select(F.explode("terms").alias("term"), F.col("terms").alias("own"), "material_idx")
    sizes = wanting.groupBy("term").agg(F.sum(F.size("requests")).alias("r")).join(having.groupBy("term").agg(F.count("*").alias("m")), "term")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = space.save(sizes.select("term", parts("r").alias("r_parts"), parts("m").alias("m_parts"), (F.col("r") * F.col("m")).alias("pairs")), "sizes")
    tasks = 1 + min(TASKS, (sizes.agg(F.sum("pairs")).first()[0] or 0) // PAIRS_A_TASK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = ["term", "r_part", "m_part"]
    left = having.join(sizes, "term").withColumn("m_part", F.pmod(F.xxhash64("material_idx"), F.col("m_parts")).cast("int")).select("term", every("r_parts").alias("r_part"), "m_part", "own", "material_idx")
    right = wanting.join(sizes, "term").withColumn("r_part", F.pmod(F.xxhash64("wanted", "row"), F.col("r_parts")).cast("int")).select("term", "r_part", every("m_parts").alias("m_part"), "wanted", "requests")
    met = left.repartition(tasks, *block).join(right.repartition(tasks, *block).hint("shuffle_hash"), block)  # Spark takes the copies of blocks for one
    first = met.where(F.element_at(F.array_intersect("wanted", "own"), 1) == F.col("term"))
    return first.select(F.explode("requests").alias("q"), "material_idx").select("q.request_id", "material_idx")


def draw_family(requests: DataFrame, stock: DataFrame, *, seed: int) -> DataFrame:
    """A material of each request's family (request_id, family, asked): of the class asked for, else of the nearest that the family has; on "auto" of any."""
    rows = surface_rows(stock).select("family", "level", "material_idx")
    of_class = sampling.weighted_draw(rows, ["family", "level"], weight=F.lit(1.0), index="material_idx", seed=seed)
    of_any = sampling.weighted_draw(rows, ["family"], weight=F.lit(1.0), index="material_idx", seed=seed).select("family", F.lit("auto").alias("level"), "material_idx", F.col("level").alias("of"))
    drawn = of_class.withColumn("of", F.col("level")).unionByName(of_any)
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in CLASSES]), c)
    met = requests.join(drawn, "family", "left").where((F.col("asked") == "auto") == F.coalesce(F.col("level") == "auto", F.col("asked") == "auto"))
    best = F.min(F.struct(F.abs(place(F.col("level")) - place(F.col("asked"))).alias("d"), place(F.col("level")).alias("k"), "of", "material_idx"))
    got = met.groupBy("request_id").agg(best.alias("b"))
    return requests.join(got, "request_id", "left").select("request_id", "family", "asked", F.col("b.of").alias("level"), F.col("b.material_idx").alias("material_idx"))


def resolve(requests: DataFrame, mappings: DataFrame, stock: DataFrame, tags: Mapping[str, list[str]], aliases: Mapping[str, str], *, seed: int) -> DataFrame:
    """The material of each request, by the first way that gives one.

    ``requests``: request_id, material_id, spec, semantic (what it is for). A named
    material serves as it is. A spec that is a class of absorption, or none, asks
    for the semantic; any other spec names a material, a meaning or a family. What
    nothing serves gets its fallback absorption. ``stock`` has material_id besides.
    """
    known = stock.groupBy("material_id").agg(F.min("material_idx").alias("exact"))
    level = absorption_word(F.col("spec"), strict=False)
    name = F.coalesce("material_id", F.when(level.isNull(), F.col("spec")))
    asked = requests.select("request_id", name.alias("material_id"), F.coalesce(level, F.lit("auto")).alias("asked"), canonical(F.coalesce(name, F.col("semantic")), aliases).alias("semantic"))
    asked = asked.join(known, "material_id", "left")
    meanings = mappings.select("semantic", F.lit(True).alias("_means")).distinct()
    families = surface_rows(stock).select("family", F.lit(True).alias("_has")).distinct()
    asked = asked.withColumn("family", family_word(F.coalesce("material_id", F.col("semantic")))).join(meanings, "semantic", "left").join(families, "family", "left")
    drawn = draw(asked.where("exact is null and _means").select("request_id", "semantic", "asked"), mappings, stock, tags, seed=seed)
    by_family = draw_family(asked.where("exact is null and _means is null and _has").select("request_id", "family", "asked"), stock, seed=seed)
    out = asked.join(drawn.select("request_id", F.col("material_idx").alias("drawn"), "fallback_from"), "request_id", "left").join(by_family.select("request_id", F.col("material_idx").alias("of_family")), "request_id", "left")
    index = F.coalesce("exact", "drawn", "of_family")
    how = F.when(F.col("exact").isNotNull(), "named").when(F.col("drawn").isNotNull(), "semantic").when(F.col("of_family").isNotNull(), "family").otherwise("fallback")
    return out.select("request_id", "semantic", "asked", index.alias("material_idx"), how.alias("how"), "fallback_from", F.when(index.isNull(), fallback_absorption(F.col("semantic"))).alias("fallback_alpha"), transmission_loss(F.col("semantic")).alias("loss_db"))


def surface_requests(rooms: DataFrame, surfaces: Sequence[str]) -> DataFrame:
    """A request for each surface of a room (room_id, level, profile: map of surface to spec, overrides: the same): overrides come first, then the profile, then the level."""
    named = rooms.select("room_id", F.posexplode(F.array(*[F.lit(x) for x in surfaces])).alias("place", "semantic"), "level", "profile", "overrides")
    pick = lambda c: F.try_element_at(F.col(c), F.col("semantic"))
    return named.select((F.col("room_id") * len(surfaces) + F.col("place")).alias("request_id"), "room_id", "semantic", F.lit(None).cast("string").alias("material_id"), F.coalesce(pick("overrides"), pick("profile"), F.col("level")).alias("spec"))


def geometry_requests(items: DataFrame) -> DataFrame:
    """Requests of furniture (request_id, material, material_id, semantic, type, absorption_class): a named material, else what it is."""
    named = F.coalesce(F.nullif(F.col("material"), F.lit("")), F.nullif(F.col("material_id"), F.lit("")))
    what = F.coalesce("semantic", "type", F.lit("structural_element"))
    return items.select("request_id", named.alias("material_id"), F.when(named.isNull(), F.coalesce("absorption_class", F.lit("auto"))).alias("spec"), what.alias("semantic"))
