"""Species refinement: counts of inventory species by map tile, and the species of a genus in a cloud's tile."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T


def lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for p in pairs.items() for v in p)), key)


def species_of_code(code: Column) -> Column:
    return lookup({c: i for i, (c, _) in enumerate(T.INVENTORY)}, code)


def genus_of_species(species: Column) -> Column:
    return lookup({i: T.genus_of(latin) for i, (_, latin) in enumerate(T.INVENTORY)}, species)


def tile_grid(points: DataFrame, size: float) -> DataFrame:
    """One row: the origin and the number of tiles each way, the grid being centred on the points' box; no tile for no points."""
    box = points.agg(*(f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max)))).where("lox is not null")
    for a in "xy":
        box = box.withColumn(f"n{a}", F.greatest(F.lit(1), F.ceil((F.col(f"hi{a}") - F.col(f"lo{a}")) / size).cast("int")))
        box = box.withColumn(f"o{a}", (F.col(f"lo{a}") + F.col(f"hi{a}")) / 2 - F.col(f"n{a}") * size / 2)
    return box.select("ox", "oy", "nx", "ny")


def tile_of(rows: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """Adds ix, iy: cut towards zero, and the last tile for what lies beyond it; what lies before the first has no tile, and is dropped."""
    placed = rows.crossJoin(F.broadcast(grid))  # one row
    for a in "xy":
        placed = placed.withColumn(f"i{a}", F.least(((F.col(a) - F.col(f"o{a}")) / size).cast("int"), F.col(f"n{a}") - 1))
    return placed.where("ix >= 0 and iy >= 0").drop("ox", "oy", "nx", "ny")


def tile_species(stands: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """(ix, iy, species, n, first_seen): known species by tile; first_seen orders ties."""
    placed = tile_of(stands.withColumn("species", species_of_code(F.col("species_code"))).where("species is not null"), grid, size)
    return placed.groupBy("ix", "iy", "species").agg(F.count("*").alias("n"), F.min("stand_id").alias("first_seen"))


def most_common(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, top): the most frequent species by the keys, the first seen of equally frequent ones."""
    best = F.max(F.struct("n", (-F.col("first_seen")).alias("f"), "species"))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.species").alias("top"))


def resolve(clouds: DataFrame, counts: DataFrame, model_based: bool = False, birch_compat: bool = True) -> DataFrame:
    """Adds species to clouds with ix, iy, genus.

    Incorrect segmentation stays so. Others gets the tile's commonest species. A genus gets its own commonest species in the tile; else,
    if model_based, the genus's first species in the table, else the tile's commonest. birch_compat: species 0 counts as none where
    the tile's commonest is asked for, as it always has.
    """
    top = most_common(counts, "ix", "iy")
    own = most_common(counts.withColumn("genus", genus_of_species(F.col("species"))), "ix", "iy", "genus").withColumnRenamed("top", "own")
    default = lookup({i: T.default_species(g) for i, g in enumerate(T.GENERA)}, F.col("genus"))
    both = clouds.join(top, ["ix", "iy"], "left").join(own, ["ix", "iy", "genus"], "left")
    common = F.nullif(F.col("top"), F.lit(0)) if birch_compat else F.col("top")
    otherwise = default if model_based else F.coalesce(common, default)
    species = F.when(F.col("genus") == T.BAD_GENUS, T.BAD_SPECIES).when(F.col("genus") == T.OTHERS_GENUS, F.coalesce(common, F.lit(T.OTHERS_SPECIES))).otherwise(F.coalesce("own", otherwise))
    return both.withColumn("species", species).drop("top", "own")


def resolve_all(clouds: DataFrame, placed: DataFrame, counts: DataFrame, empty: int = T.BAD_SPECIES) -> DataFrame:
    """resolve() of all clouds (cloud_id, genus): those without points are badly segmented, those off the map have no counts. placed: (cloud_id, ix, iy) of those on it; points: whether a cloud has any."""
    on = clouds.join(placed.select("cloud_id", "ix", "iy"), "cloud_id", "left")
    return resolve(on, counts).withColumn("species", F.when(F.col("has_points"), F.col("species")).otherwise(empty))


def cells(low: Column, high: Column, size: float) -> Column:
    """The numbers of the cells that an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def near_stands(spots: DataFrame, stands: DataFrame, size: float) -> DataFrame:
    """(spot_id, stand_id, species_code): stands within the box of that size about each spot, borders included. Cells of that size become equi-join keys.

    If both have a collection, a stand counts for spots of its own collection only, and a null one for none.
    """
    half = size / 2
    own_only = ["collection"] if "collection" in spots.columns and "collection" in stands.columns else []
    keys = spots.withColumn("cx", F.explode(cells(F.col("x") - half, F.col("x") + half, size))).withColumn("cy", F.explode(cells(F.col("y") - half, F.col("y") + half, size)))
    own = stands.select("stand_id", "species_code", F.col("x").alias("sx"), F.col("y").alias("sy"), F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"), *own_only)
    inside = (F.abs(F.col("sx") - F.col("x")) <= half) & (F.abs(F.col("sy") - F.col("y")) <= half)
    return keys.join(own, ["cx", "cy", *own_only]).where(inside).select("spot_id", "stand_id", "species_code")


def find_species(spots: DataFrame, stands: DataFrame, size: float) -> DataFrame:
    """spots (spot_id, x, y, genus) with species, by the stands about each, without any map; collections as in near_stands()."""
    found = near_stands(spots, stands, size).withColumn("species", species_of_code(F.col("species_code"))).where("species is not null")
    counts = found.groupBy(F.col("spot_id").alias("ix"), "species").agg(F.count("*").alias("n"), F.min("stand_id").alias("first_seen")).withColumn("iy", F.lit(0))
    own = spots.withColumn("ix", F.col("spot_id")).withColumn("iy", F.lit(0))
    return resolve(own, counts).select("spot_id", "genus", "species")


def find_species_by_region(spots: DataFrame, stands: DataFrame, boxes: DataFrame, size: float, cell: float) -> DataFrame:
    """find_species() among the stands (with their collection) of each spot's region alone: that of the first box that holds it, as in regions_of()."""
    region = regions_of(spots, boxes, cell).select("spot_id", "collection")
    return find_species(spots.join(region, "spot_id"), stands, size)


def regions_of(spots: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """spots (spot_id, x, y) with region and collection: the first box by its number that holds the spot, and the region's collection; null where there is none.

    boxes: (box_id, region, lox, hix, loy, hiy), put under the cells of that size that they touch.
    """
    keyed = boxes.withColumn("cx", F.explode(cells(F.col("lox"), F.col("hix"), size))).withColumn("cy", F.explode(cells(F.col("loy"), F.col("hiy"), size)))
    at = spots.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    hit = at.join(keyed, ["cx", "cy"]).where("x between lox and hix and y between loy and hiy")
    first = hit.groupBy("spot_id").agg(F.min(F.struct("box_id", "region")).alias("b")).select("spot_id", "b.region")
    return spots.join(first, "spot_id", "left").withColumn("collection", lookup(T.REGIONS, F.col("region"))).select("spot_id", "region", "collection")


def feature_tiles(stands: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """(stand_id, ix, iy): every tile whose box holds the stand, borders included, so that a stand on a border has several tiles."""
    at = stands.crossJoin(F.broadcast(grid))  # one row
    for a in "xy":
        place = (F.col(a) - F.col(f"o{a}")) / size
        at = at.withColumn(f"i{a}", F.explode(F.array_distinct(F.array(F.floor(place).cast("int"), (F.ceil(place) - 1).cast("int"))))).where(f"i{a} >= 0 and i{a} < n{a}")
    return at.select("stand_id", "ix", "iy")


def with_crs(points: DataFrame, header: DataFrame) -> DataFrame:
    """Points with their file's coordinate system (path, crs); a file without any is an error."""
    crs = F.coalesce("crs", F.raise_error(F.concat(F.lit("no coordinate system: "), F.col("path"))).cast("string"))
    return points.join(header, "path", "left").withColumn("crs", crs)


def features(pages: DataFrame, column: str) -> DataFrame:
    """A row for each feature of GeoJSON-like pages, and the link to the next page."""
    schema = "features array<struct<properties:struct<species_cd:string,region_name:string>>>, links array<struct<rel:string,href:string>>"
    page = pages.withColumn("_p", F.from_json(column, schema))
    after = F.get(F.filter("_p.links", lambda k: k.rel == "next"), F.lit(0)).href
    return page.withColumn("next", after).withColumn("_f", F.explode_outer("_p.features")).select(*(c for c in pages.columns if c != column), "next", "_f.properties.species_cd", "_f.properties.region_name")


def ring_edges(shapes: DataFrame) -> DataFrame:
    """(stand_id, x1, y1, x2, y2) of shapes (stand_id, rings: arrays of (x, y)): parts and holes alike are rings; the last point is joined to the first, and may repeat it. Null and empty rings have none."""
    ring = shapes.select("stand_id", F.explode("rings").alias("r")).where("size(r) > 0")
    after = F.concat(F.slice("r", F.lit(2), F.size("r")), F.slice("r", F.lit(1), F.lit(1)))
    pair = F.explode(F.zip_with("r", after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))))
    return ring.select("stand_id", pair.alias("e")).select("stand_id", "e.*")


def polygon_tiles(shapes: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """(stand_id, ix, iy): every tile whose box the shape touches or holds, borders included. Shapes as in ring_edges(); a place is inside if a line from it crosses the rings an odd number of times.

    Tiles on the border are those that an edge, clipped to each row of tiles, passes through. Other tiles are wholly inside or outside, so that in each row
    the crossings with its middle line say which are taken, without any test of a tile. A row is an edge in one row of tiles.
    """
    at = ring_edges(shapes).crossJoin(F.broadcast(grid))  # one row
    e = at.select("stand_id", "nx", "ny", *(((F.col(f"{a}{k}") - F.col(f"o{a}")) / size).alias(f"{b}{k}") for a, b in (("x", "u"), ("y", "v")) for k in (1, 2)))
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")

    def each(rows: DataFrame, name: str, first: Column, last: Column, n: str) -> DataFrame:
        """rows for each whole number from first to last that is a tile's."""
        lo, hi = F.greatest(first.cast("long"), F.lit(0)), F.least(last.cast("long"), F.col(n) - 1)
        return rows.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn(name, F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int")))).drop("_lo", "_hi")

    rows = each(e, "iy", F.ceil(low) - 1, F.floor(high), "ny")
    ends = [F.coalesce(F.try_divide(F.col("iy") + k - F.col("v1"), F.col("v2") - F.col("v1")), F.lit(float(k))) for k in (0, 1)]
    t = [F.greatest(F.lit(0.0), F.least(*ends)), F.least(F.lit(1.0), F.greatest(*ends))]
    u = [F.col("u1") + p * (F.col("u2") - F.col("u1")) for p in t]
    border = each(rows.withColumns({"ua": F.least(*u), "ub": F.greatest(*u)}), "ix", F.ceil("ua") - 1, F.floor("ub"), "nx").select("stand_id", "ix", "iy")
    lines = each(e, "iy", F.ceil(low - 0.5), F.ceil(high - 0.5) - 1, "ny")
    line = lines.select("stand_id", "nx", "iy", (F.col("u1") + F.try_divide(F.col("iy") + 0.5 - F.col("v1"), F.col("v2") - F.col("v1")) * (F.col("u2") - F.col("u1"))).alias("u"))
    w = Window.partitionBy("stand_id", "iy").orderBy("u")
    spans = line.select("stand_id", "nx", "iy", "u", F.lead("u").over(w).alias("to"), (F.row_number().over(w) % 2 == 1).alias("opens")).where("opens")
    inner = each(spans, "ix", F.ceil(F.col("u") - 0.5), F.floor(F.col("to") - 0.5), "nx").select("stand_id", "ix", "iy")
    return border.unionByName(inner).distinct()


def polygon_species(shapes: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """tile_species() of shapes (stand_id, species_code, rings): a shape counts in every tile that it touches."""
    known = shapes.withColumn("species", species_of_code(F.col("species_code"))).where("species is not null")
    placed = polygon_tiles(known, grid, size).join(known.select("stand_id", "species"), "stand_id")
    return placed.groupBy("ix", "iy", "species").agg(F.count("*").alias("n"), F.min("stand_id").alias("first_seen"))
