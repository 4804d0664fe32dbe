"""Table functions that give the states of small array algorithms, and what changes between two states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

STATE = "values array<int>, pointers map<string,int>, highlighted array<int>, sorted array<int>, dimmed array<int>, swapped array<int>, found int"
STEP = f"step int, {STATE}, event string"
DIMMED = 0.3


class Trace:
    """Collects numbered states."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, event: str, values: list[int], pointers: dict[str, int] | None = None, highlighted=(), done=(), dimmed=(), swapped=None, found: int | None = None) -> None:
        self.rows.append((len(self.rows), list(values), dict(pointers or {}), list(highlighted), list(done), list(dimmed), swapped and list(swapped), found, event))


def binary_search(values: list[int], target: int | None) -> Iterator[tuple]:
    if any(a > b for a, b in zip(values, values[1:])):
        raise ValueError("values must ascend")
    t = Trace()
    low, high = 0, len(values) - 1
    out: list[int] = []
    t.add("start", values, {"lo": low, "hi": high})
    while low <= high:
        mid = (low + high) // 2
        t.add("compare", values, {"lo": low, "mid": mid, "hi": high}, [mid], dimmed=out)
        if values[mid] == target:
            t.add("found", values, {"mid": mid}, dimmed=out, found=mid)
            return iter(t.rows)
        right = values[mid] < target
        out = sorted({*out, *(range(low, mid + 1) if right else range(mid, high + 1))})
        low, high = (mid + 1, high) if right else (low, mid - 1)
        t.add("rule out", values, {"lo": low, "hi": high} if low <= high else {}, dimmed=out)
    t.add("absent", values, dimmed=out)
    return iter(t.rows)


def linear_search(values: list[int], target: int | None) -> Iterator[tuple]:
    t = Trace()
    t.add("start", values)
    for i, v in enumerate(values):
        hit = v == target
        t.add("found" if hit else "compare", values, {"i": i}, () if hit else [i], dimmed=range(i), found=i if hit else None)
        if hit:
            return iter(t.rows)
    t.add("absent", values, dimmed=range(len(values)))
    return iter(t.rows)


def bubble_sort(values: list[int], target: int | None = None) -> Iterator[tuple]:
    a, t = list(values), Trace()
    n = len(a)
    t.add("start", a)
    for end in range(n - 1, 0, -1):
        done, calm = range(end + 1, n), True
        for j in range(end):
            t.add("compare", a, {"j": j}, [j, j + 1], done)
            if a[j] > a[j + 1]:
                a[j], a[j + 1] = a[j + 1], a[j]
                calm = False
                t.add("swap", a, {"j": j}, [j, j + 1], done, swapped=(j, j + 1))
        if calm:
            t.add("no swap", a, done=range(n))
            return iter(t.rows)
        t.add("placed", a, done=range(end, n))
    t.add("sorted", a, done=range(n))
    return iter(t.rows)


def insertion_sort(values: list[int], target: int | None = None) -> Iterator[tuple]:
    a, t = list(values), Trace()
    t.add("start", a, done=[0])
    for i in range(1, len(a)):
        t.add("take", a, {"key": i}, [i], range(i))
        j = i
        while j and a[j - 1] > a[j]:
            a[j - 1], a[j] = a[j], a[j - 1]
            j -= 1
            t.add("move", a, {"key": j}, [j], range(i), swapped=(j, j + 1))
        t.add("placed", a, done=range(i + 1))
    return iter(t.rows)


TRACERS: dict[str, Callable] = {}


def add_tracer(name: str, f: Callable) -> None:
    """Makes a tracer known by a name that no other has."""
    if name in TRACERS:
        raise ValueError(f"a tracer {name} is there already")
    TRACERS[name] = f


for _f in (binary_search, linear_search, bubble_sort, insertion_sort):
    add_tracer(_f.__name__, _f)


def register(spark: SparkSession) -> None:
    """Registers every tracer as ``trace_<name>(values, target)``."""
    for name, f in TRACERS.items():
        handler = type(f"Trace_{name}", (), {"eval": lambda self, values, target, f=f: f(list(values), target)})
        spark.udtf.register(f"trace_{name}", udtf(handler, returnType=STEP))


def ascending(values: Column) -> Column:
    return values == F.array_sort(values)


def changes(states: DataFrame, key: str) -> DataFrame:
    """key, step, op, name, a, b: what a state(key, step, pointers, swapped, found) changes against the one before.

    In this order: a swap, pointers that appear or move, pointers that go, a place that is found.
    """
    w = Window.partitionBy(key).orderBy("step")
    s = states.withColumn("before", F.coalesce(F.lag("pointers").over(w), F.create_map().cast("map<string,int>"))).withColumn("found_before", F.lag("found").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1")
    op = lambda kind, name, a, b: F.struct(F.lit(kind).alias("op"), name.cast("string").alias("name"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    none = F.lit(None)
    was = lambda e: F.try_element_at("before", e["key"])
    here = F.transform(
        F.filter(F.map_entries("pointers"), lambda e: was(e).isNull() | (was(e) != e["value"])),
        lambda e: F.when(was(e).isNull(), op("add", e["key"], e["value"], none)).otherwise(op("move", e["key"], e["value"], none)),
    )
    gone = F.transform(F.array_except(F.map_keys("before"), F.map_keys("pointers")), lambda k: op("remove", k, none, none))
    swap = F.when(F.col("swapped").isNotNull(), F.array(op("swap", none, F.get("swapped", 0), F.get("swapped", 1))))
    found = F.when(F.col("found").isNotNull() & ~F.col("found").eqNullSafe(F.col("found_before")), F.array(op("found", none, F.col("found"), none)))
    empty = F.slice(here, 1, 0)
    return s.select(key, "step", F.posexplode(F.concat(F.coalesce(swap, empty), here, gone, F.coalesce(found, empty))).alias("place", "o")).select(key, "step", "place", "o.*")


def cell_role(index: Column, found: Column, highlighted: Column, done: Column) -> Column:
    return F.when(found.eqNullSafe(index), "found").when(F.array_contains(highlighted, index), "highlight").when(F.array_contains(done, index), "sorted").otherwise("normal")


def cell_opacity(index: Column, dimmed: Column) -> Column:
    return F.when(F.array_contains(dimmed, index), F.lit(DIMMED)).otherwise(F.lit(1.0))
