"""Keyed tables: insert, update, delete, lookup, enrolments and rosters as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import strip
from textmill.operators.order import numbered


def insert_if_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new whose key it lacks."""
    return table.unionByName(new.join(table.select(key), key, "left_anti"))


def rejected_inserts(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(table.select(key), key, "left_semi")


def update_partial(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the given fields of changes; null or blank text leaves a field as it is, 0 counts as a value."""
    given = changes.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key))
    out = table.join(given, key, "left")
    cols: list[Column] = []
    for f in table.schema.fields:
        if f"__{f.name}" not in given.columns:
            cols.append(F.col(f.name))
            continue
        fresh = F.col(f"__{f.name}")
        if f.dataType.simpleString() == "string":
            fresh = F.when(strip(fresh) != "", fresh)
        cols.append(F.coalesce(fresh, F.col(f.name)).alias(f.name))
    return out.select(*cols)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes: fields given replace those of the same key, new keys are added, in
    one full join. changes must have each key once; a null or blank field leaves the old one."""
    given = changes.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key))
    both = table.join(given, F.col(key) == F.col("__key"), "full")

    def field(f):
        if f.name == key:
            return F.coalesce(F.col(key), F.col("__key")).alias(key)
        if f"__{f.name}" not in given.columns:
            return F.col(f.name)
        fresh = F.col(f"__{f.name}")
        if f.dataType.simpleString() == "string":
            fresh = F.when(strip(fresh) != "", fresh)
        return F.coalesce(fresh, F.col(f.name)).alias(f.name)

    return both.select(*map(field, table.schema.fields))


def delete_by_key(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def unmatched_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys asked for that the table lacks: the errors of an update or a delete."""
    return keys.select(key).distinct().join(table.select(key), key, "left_anti")


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """A filter on the key: pushed to the scan."""
    return table.where(F.col(key) == value)


def enroll_many(requests: DataFrame, first_id: int, date) -> DataFrame:
    """One enrolment for each course in requests(id_alumno, cursos): ids go on from first_id, in the
    order of student and place in the list. date is a parameter, so a rerun gives the same rows."""
    each = requests.select("id_alumno", F.posexplode(F.transform(F.split("cursos", ","), lambda x: F.trim(x))).alias("place", "id_curso"))
    each = numbered(each, ["id_alumno", "place"])
    return each.select((F.lit(first_id - 1) + F.col("number")).cast("int").alias("id_inscripcion"), "id_alumno", "id_curso", F.lit(date).cast("date").alias("fecha_inscripcion"))


def next_id(table: DataFrame, key: str, prefix: str = "", by_count: bool = False) -> DataFrame:
    """One row with the next key: the largest number + 1, or count + 1, which may collide after deletes."""
    number = F.count("*") if by_count else F.coalesce(F.max(F.regexp_extract(F.col(key).cast("string"), "([0-9]+)$", 1).cast("long")), F.lit(0))
    text = (number + 1).cast("string")
    return table.agg(F.concat(F.lit(prefix), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)).alias("next_id"))


def enrolments_of_course(enrolments: DataFrame, course) -> DataFrame:
    """The enrolments of one course: a filter that reaches the scan."""
    return lookup(enrolments, "id_curso", course)


def roster(enrolments: DataFrame, students: DataFrame, courses: DataFrame, how: str = "inner") -> DataFrame:
    """Students of courses and courses of students; how='left' keeps enrolments without a student."""
    return enrolments.join(students, "id_alumno", how).join(courses, "id_curso", how)


def count_per_course(courses: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Courses without enrolments count 0. The enrolments are counted before the join."""
    n = enrolments.groupBy("id_curso").agg(F.count("*").alias("n"))
    return courses.join(n, "id_curso", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distinct_by_key(table: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key by an explicit order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("__n", first).where("__n = 1").drop("__n")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents in gone(key) and their children."""
    keys = gone.select(F.col(key).alias("__gone")).distinct()
    return (
        parents.join(keys, F.col(key) == F.col("__gone"), "left_anti"),
        children.join(keys, F.col(parent_key) == F.col("__gone"), "left_anti"),
    )
