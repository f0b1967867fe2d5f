"""Scalar functions of the graph model as column expressions."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A role glob as an anchored regular expression: ``*`` stops at a slash, ``**`` crosses it, ``?`` is one non-slash."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + glob[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def resolve_role(path: Column, selectors: list[tuple[str, str]]) -> Column:
    """The role of the first (glob, role) selector that fits, else ''."""
    out = F.lit("")
    for glob, role in reversed(selectors):
        out = F.when(path.rlike(glob_regex(glob)), role).otherwise(out)
    return out


def package_path(kind: Column, qname: Column, node_id: Column) -> Column:
    """The package of a node: its own name for packages, else the name up to the last dot, without receiver marks."""
    plain = F.regexp_replace(qname, r"[()*]", "")
    return F.when(kind == "package", F.coalesce(F.nullif(qname, F.lit("")), F.regexp_replace(node_id, "^pkg:", ""))).otherwise(F.regexp_extract(plain, r"^(.*)\.[^.]*$", 1))


def visibility(name: Column, given: Column | None = None) -> Column:
    found = F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")
    return F.coalesce(F.nullif(given, F.lit("")), found) if given is not None else found


def node_layer(kind: Column) -> Column:
    # The layer of each node kind.
    table = {
        "structure": ("package", "file"), "model": ("type", "field"), "behavior": ("function", "method"),
        "control": ("loop", "branch"), "concurrency": ("goroutine", "defer", "channelop", "syncprim"),
    }
    out = F.lit("structure")
    for layer, kinds in table.items():
        out = F.when(kind.isin(*kinds), layer).otherwise(out)
    return out


def edge_layer(kind: Column) -> Column:
    # The layer of each edge kind.
    table = {"structure": ("contains",), "dependency": ("dependsOn", "references"), "type": ("implements", "embeds", "usesType", "returns"), "call": ("calls", "callsFrom")}
    out = F.lit("structure")
    for layer, kinds in table.items():
        out = F.when(kind.isin(*kinds), layer).otherwise(out)
    return out


def excluded(path: Column, rules: list[str]) -> Column:
    """A rule with a slash fits exactly or as a prefix, one without fits any segment."""
    out = F.lit(False)
    for rule in rules:
        out = out | ((path == rule) | path.startswith(rule.rstrip("/") + "/") if "/" in rule else F.array_contains(F.split(path, "/"), rule))
    return out


# --- names and lists --------------------------------------------------------------------------


def slug(graph_id: Column) -> Column:
    """A graph's id as a folder name: other characters become ``_``; never empty."""
    return F.coalesce(F.nullif(F.regexp_replace(graph_id, r"[^A-Za-z0-9\-_.]", "_"), F.lit("")), F.lit("graph"))


def slugify_name(name: Column) -> Column:
    """A name as part of a path: ASCII letters, digits, ``-`` and ``_``; an empty one is ``_``."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"[^A-Za-z0-9\-_]", "_"), F.lit("")), F.lit("_"))


def split_list(text: Column) -> Column:
    """The trimmed parts of a comma-separated text, without empty ones: labels, tags, seeds."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def join_tags(tags: Column, extra: Column) -> Column:
    """Tags as text with ``extra`` among them once, at the end if it is new."""
    return F.array_join(F.when(F.array_contains(tags, extra), tags).otherwise(F.concat(tags, F.array(extra))), ",")


def short_import_path(path: Column, depth: int) -> Column:
    """The last ``depth`` segments of a path; all of it for a depth of 0 or less."""
    parts = F.split(path, "/")
    return path if depth <= 0 else F.when(F.size(parts) <= depth, path).otherwise(F.array_join(F.slice(parts, -depth, depth), "/"))


def split_identifier(identifier: Column) -> Column:
    """(package, name) around the last dot; both empty where either is."""
    package = F.regexp_extract(identifier, r"^(.+)\.([^.]+)$", 1)
    return F.struct(package.alias("package"), F.regexp_extract(identifier, r"^(.+)\.([^.]+)$", 2).alias("name"))


def exported(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Z]"), F.lit(False))


def xml_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def in_package(qname: Column, package: str) -> Column:
    """Whether a qualified name belongs to a package: it, or behind it with a dot, also as a receiver."""
    return (qname == package) | qname.startswith(package + ".") | qname.startswith(f"({package}.") | qname.startswith(f"(*{package}.")


def node_id(path: Column, line: Column, column: Column, kind: Column, name: Column, ordinal: Column) -> Column:
    """path:line:column:kind, then :name and #ordinal where there is one."""
    text = lambda c: c.cast("string")
    base = F.concat_ws(":", path, text(line), text(column), kind)
    base = F.concat(base, F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(":"), name)).otherwise(F.lit("")))
    return F.concat(base, F.when(ordinal > 0, F.concat(F.lit("#"), text(ordinal))).otherwise(F.lit("")))


def package_id(path: Column, kind: Column | None = None) -> Column:
    base = F.concat(F.lit("pkg:"), path)
    return base if kind is None else F.concat(base, F.when(kind != "", F.concat(F.lit(":"), kind)).otherwise(F.lit("")))


def first_of(attrs: Column, *names: str) -> Column:
    """The first of the named attributes that isn't empty, else ''."""
    return F.coalesce(*(F.nullif(F.try_element_at(attrs, F.lit(n)), F.lit("")) for n in names), F.lit(""))


def dedup_sorted(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x != "")))


def sample_ids(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


# --- numbers ----------------------------------------------------------------------------------


def round_half_away(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def newton_sqrt(x: Column, rounds: int = 40) -> Column:
    """The square root by ``rounds`` Newton steps from x; 0 for what isn't positive."""
    value = x.cast("double")
    step = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), value, lambda z, _: (z + value / z) / 2)
    return F.when(value > 0, step).otherwise(F.lit(0.0))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of a call at prices for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def permutations(k: int) -> list[list[int]]:
    return [list(p) for p in itertools.permutations(range(k))]


# --- attributes, digests, envelopes -----------------------------------------------------------


def coerced_kind(text: Column) -> Column:
    """The type that an attribute's text stands for: bool, int, float or string."""
    number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(text.isin("true", "false"), "bool").when(text.rlike(r"^[+-]?\d+$") & text.try_cast("long").isNotNull(), "int").when(number, "float").otherwise("string")


def coerced_number(text: Column) -> Column:
    """An attribute as a number, null if it is none; true and false are 1 and 0."""
    return F.when(text == "true", 1.0).when(text == "false", 0.0).when(coerced_kind(text).isin("int", "float"), text.try_cast("double"))


def selected_attrs(attrs: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(attrs, lambda k, v: k.isin(*names))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of ASCII text as 16 hex digits, in halves of 32 bits so that nothing overflows."""
    mask = 0xFFFFFFFF
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc: Column, c: Column) -> Column:
        low = acc["lo"].bitwiseXOR(F.ascii(c).cast("long"))
        # the prime is 2^40 + 435
        product = low * 435
        high = acc["hi"] * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(mask).cast("long")).alias("hi"), product.bitwiseAND(F.lit(mask).cast("long")).alias("lo"))

    end = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.concat(half(end["hi"]), half(end["lo"]))


def utc_stamp(ts: Column) -> Column:
    """A moment in UTC to the second, as 2006-01-02T15:04:05Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def envelope(version: int, **parts: Column) -> Column:
    """A versioned JSON document of the given parts."""
    return F.to_json(F.struct(F.lit(version).alias("version"), *(c.alias(n) for n, c in parts.items())))


def open_envelope(text: Column, version: int, schema: str) -> Column:
    """The document, null if it is of another version or malformed."""
    found = F.from_json(text, schema)
    return F.when(F.get_json_object(text, "$.version") == str(version), found)
