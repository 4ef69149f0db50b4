"""What was probably meant by a name that does not exist, and where a name could come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def similar_members(asked: DataFrame, members: DataFrame, most: int = 3, least: float = 0.75) -> DataFrame:
    """package, name, rank, suggestion: the members of a package that come nearest to asked names (package, name).

    First those that begin with the name, then those that hold it in any case, then those with an edit similarity of `least` and more; names that end with Value first
    and shorter ones first, of the last kind the most similar first. members has package and name; only members of the same package meet.
    """
    own = members.select("package", F.col("name").alias("member")).distinct()
    met = asked.select("package", "name").distinct().join(own, "package").where("member <> name")
    like = 1 - F.levenshtein("name", "member") / F.greatest(F.char_length("name"), F.char_length("member"), F.lit(1))
    kind = F.when(F.startswith("member", "name"), 0).when(F.contains(F.lower("member"), F.lower("name")), 1).when(like >= least, 2)
    rows = met.withColumn("like", F.round(like, 6)).withColumn("kind", kind).where("kind is not null")
    order = [F.col("kind"), F.when(F.col("kind") == 2, -F.col("like")).otherwise(F.when(F.endswith("member", F.lit("Value")), 0.0).otherwise(1.0)), F.when(F.col("kind") == 2, 0).otherwise(F.char_length("member")), F.col("member")]
    place = F.row_number().over(Window.partitionBy("package", "name").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= most).select("package", "name", "rank", F.concat_ws("::", "package", written("member")).alias("suggestion"))


def written(name: str):
    """A name as it can be written: in quotes if it is no identifier."""
    return F.when(F.col(name).rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col(name)).otherwise(F.concat(F.lit("'"), F.col(name), F.lit("'")))


def import_hints(asked: DataFrame, members: DataFrame, preferred: tuple[str, ...], most: int = 2) -> DataFrame:
    """name, rank, package: the packages that show asked names (name): preferred ones in their order, then the less nested, then the shorter, then by name."""
    rows = asked.select("name").distinct().join(members.select("package", "name").distinct(), "name")
    first = F.lit(len(preferred))
    for k, p in enumerate(preferred):
        first = F.when(F.col("package") == p, k).otherwise(first)
    depth = F.size(F.split("package", "::"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(first, depth, F.char_length("package"), "package"))
    return rows.withColumn("rank", place).where(F.col("rank") <= most).select("name", "rank", "package")
