"""Scans of observation files, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBS_SCHEMA = "id bigint, lat double, lon double, taxon bigint, day string, rank string"
# Places of the published positional rows.
ROW = ("lat", "lon", "discover", "conservation", "env", "staleness", "urgency", "travel_min", "n_train")


def read_csv(spark: SparkSession, path: str, schema: str = OBS_SCHEMA, tolerant: bool = False) -> DataFrame:
    """Typed scan; the tolerant form drops rows that do not parse."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED" if tolerant else "PERMISSIVE").csv(path)


_GROUP = r"inat_(?:east_)?([A-Za-z]+)"


def _with_group(rows: DataFrame, path: Column, name: str) -> DataFrame:
    file = F.regexp_extract(path, r"([^/]+/[^/]+)$", 1)
    return rows.withColumns({"group": F.regexp_extract(file, name, 1), "region": F.when(F.contains(file, F.lit("inat_east_")), "east").otherwise("bc")})


def read_by_group(spark: SparkSession, pattern: str, schema: str = OBS_SCHEMA, name: str = _GROUP) -> DataFrame:
    """Files of several groups, the group and region taken from the file's name."""
    return _with_group(read_csv(spark, pattern, schema), F.input_file_name(), name)


def count_by_group(spark: SparkSession, pattern: str, schema: str = OBS_SCHEMA, name: str = _GROUP) -> DataFrame:
    """(group, region, n): the rows of ``read_by_group``, counted by file, so that a name is read once a file."""
    files = read_csv(spark, pattern, schema).groupBy(F.input_file_name().alias("__file")).agg(F.count("*").alias("n"))
    return _with_group(files, F.col("__file"), name).groupBy("group", "region").agg(F.sum("n").alias("n"))


def day_of(text: Column) -> Column:
    """A date, null where the text is none."""
    return text.try_cast("date")


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """(grp, named columns) of JSON documents {group: [[..9 numbers..], ..]}."""
    docs = spark.read.option("wholetext", True).text(path)
    groups = docs.select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("grp", "rows"))
    row = groups.select("grp", F.explode("rows").alias("r"))
    return row.select("grp", *[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(ROW)])


def positional_json(grid: DataFrame) -> DataFrame:
    """(grp, doc): one compact document for each group of published cells."""
    rows = F.sort_array(F.collect_list(F.array(*[F.col(c).cast("double") for c in ROW])))
    return grid.groupBy("grp").agg(F.to_json(F.map_from_arrays(F.array(F.first("grp")), F.array(rows))).alias("doc"))


def keyset_page(df: DataFrame, key: str, below: int | None, size: int) -> DataFrame:
    """One page in descending key order, below a cursor."""
    page = df if below is None else df.where(F.col(key) < below)
    return page.orderBy(F.col(key).desc()).limit(size)


def keyset_pages(df: DataFrame, key: str, size: int, pages: int) -> DataFrame:
    """The first pages, with their number: what paging to a cap returns, as one scan."""
    from pyspark.sql import Window

    top = df.orderBy(F.col(key).desc()).limit(size * pages)
    return top.withColumn("page", F.floor((F.row_number().over(Window.orderBy(F.col(key).desc())) - 1) / size).cast("int"))


def union_pulls(*pulls: DataFrame, key: str = "id") -> DataFrame:
    """Overlapping pulls as one, the first row of each key kept in the order of the pulls."""
    from pyspark.sql import Window

    tagged = [p.withColumn("__pull", F.lit(i)) for i, p in enumerate(pulls)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__pull"))).where("__n = 1").drop("__n", "__pull")


def write_cells_csv(cells: DataFrame, path: str) -> None:
    """Cell tables as CSV with a header; nulls are empty fields."""
    cells.write.option("header", True).option("nullValue", "").mode("overwrite").csv(path)


def read_cells_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_results_json(results: DataFrame, path: str) -> None:
    """One JSON document a row and line; absent values are left out."""
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.mode("overwrite").text(path)


def read_results_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_groups(grid: DataFrame, path: str) -> None:
    """Positional documents under ``path``/group=.., and ``path``/index with the groups' cell counts."""
    positional_json(grid).select(F.col("grp").alias("group"), F.col("doc").alias("value")).write.mode("overwrite").partitionBy("group").text(f"{path}/groups")
    index = grid.groupBy("grp").agg(F.count(F.lit(1)).alias("n_cells"))
    write_results_json(index, f"{path}/index")


def patch_groups(spark: SparkSession, path: str, patched: str, value: DataFrame, column: str, but: tuple[str, ...] = ()) -> None:
    """The documents under ``path`` again under ``patched``, one column taken from ``value`` (lat, lon,
    value; 0 where it has no such cell), except for some groups."""
    rows = read_positional(spark, f"{path}/groups/*")
    new = F.when(F.col("grp").isin(*but), F.col(column)) if but else F.when(F.lit(False), F.col(column))
    rows = rows.join(value.withColumnRenamed("value", "__new"), ["lat", "lon"], "left").withColumn(column, new.otherwise(F.coalesce("__new", F.lit(0.0)))).drop("__new")
    write_groups(rows, patched)


def write_keys(keys: DataFrame, path: str) -> None:
    """Hidden cells as one key a line."""
    keys.select(F.col("key").alias("value")).write.mode("overwrite").text(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("key"))


def match_names(names: DataFrame, backbone: DataFrame) -> DataFrame:
    """(name, key): names that the backbone (name, key) has, whatever their case and outer spaces;
    others are dropped."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    known = backbone.groupBy(plain("name").alias("__name")).agg(F.min("key").alias("key"))
    return names.join(known, plain("name") == F.col("__name")).select("name", "key")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(country, ring, x1, y1, x2, y2): the edges of GeoJSON polygons, keyed by country."""
    shape = "features array<struct<properties: struct<country: string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    docs = spark.read.option("wholetext", True).text(path)
    features = docs.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    rings = features.select(F.col("f.properties.country").alias("country"), F.posexplode("f.geometry.coordinates").alias("ring", "r"))
    edges = rings.select("country", "ring", F.explode(F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("a"), F.slice("r", 2, F.size("r") - 1).alias("b"))).alias("e"))
    return edges.select("country", "ring", *[F.get(F.col("e")[k], F.lit(i)).alias(n) for n, k, i in (("x1", "a", 0), ("y1", "a", 1), ("x2", "b", 0), ("y2", "b", 1))])
