"""Triples from Turtle files: (s, p, o, o_kind, o_dtype), as a set, read file by file in parallel."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.session import ship

from .heads import read_heads

SCHEMA = "s string, p string, o string, o_kind string, o_dtype string, file string"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Prefixes of the vocabulary.
PREFIXES = {
    "saref": "https://saref.etsi.org/core/", "s4ener": "https://saref.etsi.org/saref4ener/", "s4bldg": "https://saref.etsi.org/saref4bldg/",
    "bot": "https://w3id.org/bot#", "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#", "geosparql": "http://www.opengis.net/ont/geosparql#",
    "om": "http://www.wurvoc.org/vocabularies/om-1.8/", "ex": "https://example.org/", "ex-ont": "https://example.org/ontology#", "ic": "https://interconnectproject.eu/example/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": XSD,
}
#: Fixed value: how serial numbers of a maker's devices begin.
SERIAL = "urn:Device:SmartThings:"
TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<dtype>\^\^)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)|[0-9]*\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<blank>_:[\w.-]*\w)|(?P<name>[\w-]*:(?:[\w%-]|\.(?=[\w%-])|\\.|:)*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.X,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _plain(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), s)


def parse_turtle(text: str) -> Iterator[tuple[str, str, str, str, str | None]]:
    """Triples of a document of prefixes, subjects, predicate lists (;), object lists (,) and literals.

    Nested blank nodes and collections raise ValueError, as other malformed input does.
    """
    prefixes: dict[str, str] = {}
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no Turtle at {text[at : at + 30]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    k = 0

    def iri(kind: str, x: str) -> str:
        if kind == "iri":
            return x[1:-1]
        if kind == "blank":
            return x
        if kind != "name":
            raise ValueError(f"{x!r} is no resource")
        p, _, local = x.partition(":")
        if p not in prefixes:
            raise ValueError(f"unknown prefix {p!r}")
        return prefixes[p] + local.replace("\\", "")

    while k < len(tokens):
        kind, x = tokens[k]
        if x.lower() in ("@prefix", "prefix"):
            prefixes[tokens[k + 1][1].rstrip(":")] = tokens[k + 2][1][1:-1]
            k += 4 if x[0] == "@" else 3
            continue
        s, k = iri(kind, x), k + 1
        while True:
            p = RDF_TYPE if tokens[k] == ("word", "a") else iri(*tokens[k])
            k += 1
            while True:
                kind, x = tokens[k]
                k += 1
                if kind in ("text", "long"):
                    n = 3 if kind == "long" else 1
                    dtype = None
                    if tokens[k][0] == "dtype":
                        dtype, k = iri(*tokens[k + 1]), k + 2
                    elif tokens[k][0] == "lang":
                        dtype, k = tokens[k][1], k + 1
                    yield s, p, _plain(x[n:-n]), "literal", dtype
                elif kind == "number":
                    yield s, p, x, "literal", XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer")
                elif kind == "word" and x in ("true", "false"):
                    yield s, p, x, "literal", XSD + "boolean"
                else:
                    yield s, p, iri(kind, x), "blank" if kind == "blank" else "iri", None
                if tokens[k][1] != ",":
                    break
                k += 1
            if tokens[k][1] != ";":
                break
            while tokens[k][1] == ";":
                k += 1
            if tokens[k][1] == ".":
                break
        if tokens[k][1] != ".":
            raise ValueError(f"no full stop but {tokens[k][1]!r}")
        k += 1


def read_turtle(spark: SparkSession, *paths: str, recursive: bool = False, glob: str = "*.ttl") -> DataFrame:
    """The set of all triples in the files, each parsed by one task; with the file they come from in a column."""
    ship(spark)
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(list(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["s", "p", "o", "o_kind", "o_dtype"]
        for f in frames:
            for text, file in zip(f["value"], f["file"], strict=True):
                yield pd.DataFrame(list(parse_turtle(text)), columns=names, dtype=object).assign(file=file)

    return files.mapInPandas(run, SCHEMA)


def graph(*parts: DataFrame) -> DataFrame:
    """Union of triple frames as a set."""
    out = parts[0].select("s", "p", "o", "o_kind", "o_dtype")
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out.distinct()


def there(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def read_if_there(spark: SparkSession, path: str, **how) -> DataFrame:
    """read_turtle, or no triples if the path doesn't exist."""
    return read_turtle(spark, path, **how) if there(spark, path) else spark.createDataFrame([], SCHEMA)


def read_floors(spark: SparkSession, folder: str, floors: list[int] | None, kind: str) -> DataFrame:
    """Triples of floor_{n}_{kind}.ttl for the floors asked for, missing files skipped with a warning; ValueError without floors."""
    if floors is None:
        raise ValueError("floors must be given")
    parts = []
    for n in floors:
        path = f"{folder}/floor_{n}_{kind}.ttl"
        if not there(spark, path):
            warnings.warn(f"there is no {path}", stacklevel=2)
        parts.append(read_if_there(spark, path).withColumn("floor", F.lit(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def device_headers(spark: SparkSession, path: str, lines: int = 20, **options) -> DataFrame:
    """file, device_id, parent_serial, found in each file's first lines; nothing beyond them is read. Either is NULL
    where the lines don't tell it. Options are those of heads.FileHeads."""
    found = lambda p: F.nullif(F.regexp_extract("head", p, 1), F.lit(""))
    rows = read_heads(spark, path, "*.ttl", lines, **options)
    return rows.select("file", found(r"(?m)^(ic:\S+)[ \t]+a[ \t]+s4ener:Device").alias("device_id"), found(r'ic:hasParentSerialNumber[ \t]+"([^"\n]+)"').alias("parent_serial"))


def device_ids(headers: DataFrame) -> DataFrame:
    """(file, device_id) of device_headers, with a row for each name that a file gives its device."""
    both = headers.select("file", F.explode(F.array("device_id", "parent_serial")).alias("device_id"))
    return both.where("device_id is not null").distinct()


def read_devices(spark: SparkSession, folder: str) -> DataFrame:
    """The triples of all device files, which lie two folders deep: {folder}/devices/*/*.ttl; none if there are none."""
    return read_if_there(spark, f"{folder}/devices/*/*.ttl")


def read_devices_of(spark: SparkSession, folder: str, uris: DataFrame) -> DataFrame:
    """The triples of the devices asked for (uri): only the files are parsed whose first lines name one of them."""
    index = device_index(device_ids(device_headers(spark, f"{folder}/devices")))
    files = [r.file for r in files_of(index, uris).collect()]  # names of files that are read next
    return read_turtle(spark, *files) if files else spark.createDataFrame([], SCHEMA)


def expand(c: Column, prefixes: dict[str, str]) -> Column:
    """Prefixed names as whole ones."""
    out = c
    for p, whole in prefixes.items():
        out = F.when(c.startswith(f"{p}:"), F.concat(F.lit(whole), F.substr(c, F.lit(len(p) + 2)))).otherwise(out)
    return out


def device_index(ids: DataFrame, prefixes: dict[str, str] = PREFIXES) -> DataFrame:
    """uri and files (file, device_id), of rows (file, device_id): where each device is told of. Serial numbers of
    the kind urn:Device:SmartThings:... are names below ic:device_."""
    named = F.when(F.col("device_id").startswith(SERIAL), F.concat(F.lit(prefixes["ic"] + "device_"), "device_id")).otherwise(expand(F.col("device_id"), prefixes))
    whole = ids.where(F.col("device_id").isNotNull()).select(named.alias("uri"), F.struct("file", "device_id").alias("x")).distinct()
    return whole.groupBy("uri").agg(F.array_sort(F.collect_list("x")).alias("files"))


def files_of(index: DataFrame, uris: DataFrame) -> DataFrame:
    """The files that tell of the devices asked for (uri)."""
    return index.join(uris.select("uri").distinct(), "uri", "left_semi").select(F.explode("files.file").alias("file")).distinct()


def turtle_lines(triples: DataFrame) -> DataFrame:
    """A line of N-Triples (a subset of Turtle) for each triple; write it with df.write.text."""
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    lit = F.concat(F.lit('"'), esc, F.lit('"'), F.when(F.col("o_dtype").startswith("@"), F.col("o_dtype")).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), "o_dtype", F.lit(">"))).otherwise(""))
    obj = F.when(F.col("o_kind") == "literal", lit).when(F.col("o_kind") == "blank", F.col("o")).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    return triples.select(F.concat_ws(" ", subject, F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("value"))
