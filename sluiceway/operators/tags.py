"""XML-like documents to rows: elements with their context path and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without an end tag, and what a tag looks like.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
TAG = r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:\s++[A-Za-z_:][A-Za-z0-9_:.-]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+)\s*+(/?)>"


def elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, path, attributes``: each element of each document with the path of open elements above it.

    ``attributes`` maps names to values; of repeated names the first holds.  End tags close the
    nearest open element; tags that never close stay open to the end.  A document is settled
    where it is read: nothing is shuffled.  Repeats are possessive, so tags of any length match.
    """
    part = lambda tag, k: F.regexp_extract(tag, "^" + TAG + "$", k)

    def cut(tag: Column, at: Column) -> Column:
        name = F.lower(part(tag, 2))
        return F.struct(at.alias("at"), (part(tag, 1) == "/").alias("ends"), name.alias("name"), part(tag, 3).alias("attrs"), ((part(tag, 4) == "/") | name.isin(*VOID)).alias("empty"))

    tags = docs.select(key, F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), cut).alias("t"))
    walk = """aggregate(t, named_struct('open', cast(array() as array<string>), 'out', cast(array() as array<struct<at:int,path:string,attrs:string>>)),
        (s, x) -> if(x.ends,
            named_struct('open', if(array_contains(s.open, x.name), slice(s.open, 1, size(s.open) - cast(array_position(reverse(s.open), x.name) as int)), s.open), 'out', s.out),
            named_struct('open', if(x.empty, s.open, array_append(s.open, x.name)),
                         'out', array_append(s.out, named_struct('at', x.at, 'path', array_join(array_append(s.open, x.name), '/'), 'attrs', x.attrs)))),
        s -> s.out)"""
    rows = tags.select(key, F.explode(F.expr(walk)).alias("e")).select(key, "e.at", "e.path", "e.attrs")
    name, value = r"([A-Za-z_:][A-Za-z0-9_:.-]*+)", r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))"
    get = lambda p: F.struct(F.lower(F.regexp_extract(p, name, 1)).alias("k"), F.concat(*(F.regexp_extract(p, name + value, k) for k in (2, 3, 4))).alias("v"))
    rows = rows.withColumn("found", F.transform(F.regexp_extract_all("attrs", F.lit(name + value), F.lit(0)), get))
    first = F.filter("found", lambda x, i: F.array_position(F.col("names"), x["k"]) == i + 1)
    rows = rows.withColumn("names", F.col("found.k"))
    return rows.select(key, "at", "path", F.map_from_entries(first).alias("attributes"))
