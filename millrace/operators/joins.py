"""Joins and table comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.semantics import NESTED, col, dtype_name, small_table
from millrace.session import cut_lineage

#: A lookup side is broadcast only if it was measured and has no more rows and bytes (as JSON) than this.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of a lookup table, written once and measured: with a broadcast hint if small, else AQE picks the join."""
    kept = cut_lineage(df)
    rows, size = kept.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(kept) if rows <= limit and (size or 0) <= limit_bytes else kept


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other and shared names get ``_x`` / ``_y``.

    Equal key names give one key column. ``<=>`` on the keys still plans as a hash or
    sort-merge join, and AQE splits skewed keys. In a full join, which AQE does not split, heavy
    keys, null among them, are dealt by ``_full``.
    """
    how = {"outer": "full"}.get(how, how)
    shared = (set(left.columns) & set(right.columns)) - ({left_on} if left_on == right_on else set())
    l_names = {c: f"{c}_x" if c in shared else c for c in left.columns}
    r_names = {c: f"{c}_y" if c in shared else c for c in right.columns}
    one_key = left_on == right_on
    a = left.select(*[col(c).alias(n) for c, n in l_names.items()])
    b = right.select(
        *[col(c).alias("__right_key" if one_key and c == right_on else n) for c, n in r_names.items()]
    )
    r_key = "__right_key" if one_key else r_names[right_on]
    if how == "full":
        out = _full(a, b, l_names[left_on], r_key)
    else:
        out = a.join(b, col(l_names[left_on]).eqNullSafe(col(r_key)), how)
    if one_key:
        out = out.withColumn(left_on, F.coalesce(col(left_on), F.col("__right_key"))).drop("__right_key")
    return out


def _part_of_row(df: DataFrame, parts: Column) -> Column:
    """One of ``parts`` for each row, by its values, so that a task that runs again deals alike."""
    plain = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (*NESTED, T.VariantType))]
    return F.pmod(F.xxhash64(*plain), parts).cast("int")


def _heavy_keys(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame | None:
    """__key, its rows __a and __b on both sides, and __i and __j, the parts they are dealt into.

    Heavy is a key with more rows than an even share of a side's rows for one of the shuffle partitions, so there are at most
    as many as partitions on each side. None if no key is.
    """
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides, shares = [], []
    for df, k in ((a, left), (b, right)):
        counts = df.groupBy(col(k).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
        shares.append(max(1, -(-df.count() // parts)))
        sides.append(counts.where(F.col("__n") > shares[-1]).select("__key"))
    keys = cut_lineage(sides[0].unionByName(sides[1]).distinct())
    if keys.isEmpty():
        return None
    few = small_side(keys)
    for (df, k), name in zip(((a, left), (b, right)), ("__a", "__b")):
        one = df.select(col(k).alias("__own")).join(few, F.col("__own").eqNullSafe(F.col("__key")))
        found = one.groupBy(F.col("__own").alias("__of")).agg(F.count(F.lit(1)).alias(name))
        keys = keys.join(found, F.col("__key").eqNullSafe(F.col("__of")), "left").drop("__of")
    keys = keys.na.fill(0, ["__a", "__b"])
    deal = lambda n, share: F.greatest(F.ceil(F.col(n) / F.lit(share)), F.lit(1)).cast("int")
    return small_side(keys.select("__key", "__a", "__b", deal("__a", shares[0]).alias("__i"), deal("__b", shares[1]).alias("__j")))


def _full(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Full outer join on null-safe equal keys, with heavy keys apart.

    Whether a row of a heavy key has a partner depends on its key alone. So rows of a key that only one side has go
    straight to the result, and those of a key that both have make an inner join of cells: each side deals its
    rows into parts and copies them for every part of the other side. Light keys join as usual. Rows that are equal
    in every column share a part.
    """
    heavy = _heavy_keys(a, b, left, right)
    if heavy is None:
        return a.join(b, col(left).eqNullSafe(col(right)), "full")
    apart = lambda df, k: df.join(heavy, col(k).eqNullSafe(F.col("__key")))
    light = lambda df, k: df.join(heavy.select("__key"), col(k).eqNullSafe(F.col("__key")), "left_anti")
    x, y = apart(a, left), apart(b, right)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells_x = x.where("__b > 0").withColumns({"__at_i": _part_of_row(a, F.col("__i")), "__at_j": every("__j")})
    cells_y = y.where("__a > 0").withColumns({"__to_j": _part_of_row(b, F.col("__j")), "__to_i": every("__i")})
    meet = col(left).eqNullSafe(col(right)) & (F.col("__at_i") == F.col("__to_i")) & (F.col("__at_j") == F.col("__to_j"))
    names = [col(c) for c in [*a.columns, *b.columns]]
    drop = ("__key", "__a", "__b", "__i", "__j")
    parts = [
        light(a, left).join(light(b, right), col(left).eqNullSafe(col(right)), "full"),
        cells_x.drop(*drop).join(cells_y.drop(*drop), meet),
        x.where("__b = 0").select(*(col(c) for c in a.columns)),
        y.where("__a = 0").select(*(col(c) for c in b.columns)),
    ]
    out = parts[0].select(*names)
    for part in parts[1:]:
        have = set(part.columns)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in [*a.schema.fields, *b.schema.fields] if f.name not in have}
        out = out.unionByName(part.withColumns(missing).select(*names))
    return out


def keep_top_keys(df: DataFrame, key: str, value: str | None, n: int) -> DataFrame:
    """Rows whose key is among the ``n`` largest by sum of ``value`` (or by row count)."""
    size = F.sum(col(value)) if value else F.count(F.lit(1))
    top = (
        df.where(col(key).isNotNull())
        .groupBy(col(key))
        .agg(size.alias("__size"))
        .orderBy(F.desc("__size"), col(key))
        .limit(n)
    )
    return df.join(small_side(top.select(col(key))), key, "left_semi")


def look_up(df: DataFrame, column: str, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Map a column through a two-column table; unknown values give null."""
    pairs = table.select(col(key).alias("__key"), col(value).alias(name))
    return df.join(small_side(pairs), col(column) == F.col("__key"), "left").drop("__key")


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shapes, shared and missing columns, and column counts per type."""
    size = {n: t.count() for n, t in (("a", a), ("b", b))}
    rows = [
        ("shape", "rows", str(size["a"]), str(size["b"])),
        ("shape", "columns", str(len(a.columns)), str(len(b.columns))),
    ]
    types = {"a": dict(), "b": dict()}
    for n, t in (("a", a), ("b", b)):
        for f in t.schema.fields:
            kind = dtype_name(f.dataType)
            types[n][kind] = types[n].get(kind, 0) + 1
    for c in sorted(set(a.columns) | set(b.columns)):
        section = "common" if c in a.columns and c in b.columns else "only_a" if c in a.columns else "only_b"
        rows.append((section, c, str(c in a.columns).lower(), str(c in b.columns).lower()))
    for kind in sorted(set(types["a"]) | set(types["b"])):
        rows.append(("types", kind, str(types["a"].get(kind, 0)), str(types["b"].get(kind, 0))))
    return small_table(a.sparkSession, rows, "section string, key string, a string, b string")
