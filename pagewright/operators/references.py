"""References to records that do not exist: orphan search with compressed bitmaps.

Keys of pages and of references become integers: a key range (a hash bucket of
the key) and an ordinal in the dictionary of the range. Pages alone give the
parent bitmaps of a range: one for each month in which pages first came, one
for each set of types that a declaration allows, one of the deleted. References, counted once for each
(key, month, row type, field), give a bitmap for each kind. reference AND-NOT
parent leaves the suspects, which are decoded to keys and only then meet their
rows; an exact comparison gives the reason. Bitmaps are stored as in roaring
containers: a sorted uint16 list while sparse, 8 KB of bits when dense.

The page table is read once. A popular key reaches its range only once for each
kind; rows of hot keys are split over salts in the last join.

Defined results: null entries, and entries whose slug is empty after
normalising, refer to nothing and give no row. Repeated equal entries of a row
give one row. A null period (indexed_at) is period 0, and is never late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut_lineage, estimated_bytes, parallelism, salted_join

FIELD_KEYS = ("sources", "concepts", "document_refs", "superseded_by")
CONTAINER = 1 << 16
SPARSE = 4096


def pack_container(ordinals: np.ndarray) -> bytes:
    """Sorted unique uint16 ordinals as a tagged container."""
    if len(ordinals) <= SPARSE:
        return b"a" + ordinals.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, np.uint8)
    bits[ordinals] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpack_container(data: bytes) -> np.ndarray:
    """Ordinals of a container; null or empty gives none."""
    if not data:
        return np.zeros(0, np.int64)
    if data[:1] == b"a":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little")).astype(np.int64)


def and_not(left: bytes, right: bytes) -> np.ndarray:
    """Ordinals of left that right lacks, word by word if both are dense."""
    if left and right and left[:1] == b"b" and right[:1] == b"b":
        a, b = (np.frombuffer(x, np.uint8, offset=1) for x in (left, right))
        return np.flatnonzero(np.unpackbits(a & ~b, bitorder="little")).astype(np.int64)
    a = unpack_container(left)
    if right and right[:1] == b"b":  # sparse against dense: one look a bit
        bits = np.frombuffer(right, np.uint8, offset=1)
        return a[bits[a >> 3] >> (a & 7) & 1 == 0]
    b = unpack_container(right)
    if not len(b):
        return a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return a[b[at] != a]


class Bitmap:
    """Set of ordinals of one key range: a packed container for each 65,536 of them."""

    def __init__(self, parts: dict[int, bytes]):
        self.parts = parts

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        """Bitmap of any ordinals, repeats included."""
        bits = np.unique(ordinals)
        if not len(bits):
            return cls({})
        if bits[-1] < CONTAINER:
            return cls({0: pack_container(bits)})
        cuts = np.flatnonzero(np.diff(bits // CONTAINER)) + 1
        return cls({int(part[0]) // CONTAINER: pack_container(part % CONTAINER) for part in np.split(bits, cuts)})

    def __or__(self, other: Bitmap) -> Bitmap:
        out = dict(self.parts)
        for k, data in other.parts.items():
            out[k] = pack_container(np.union1d(unpack_container(out[k]), unpack_container(data))) if k in out else data
        return Bitmap(out)

    def minus(self, other: Bitmap) -> Bitmap:
        """self AND-NOT other."""
        left = {k: and_not(data, other.parts[k]) if k in other.parts else None for k, data in self.parts.items()}
        return Bitmap({k: self.parts[k] if bits is None else pack_container(bits) for k, bits in left.items() if bits is None or len(bits)})

    def ordinals(self) -> np.ndarray:
        """Decoded bits in order."""
        return np.concatenate([unpack_container(d) + k * CONTAINER for k, d in sorted(self.parts.items())] or [np.zeros(0, np.int64)])


def with_key(rows: DataFrame, entry: str, own_wiki: Column) -> DataFrame:
    """Adds key, wiki <NUL> slug of an entry; own_wiki null means a page of that slug in any wiki.

    Spaces are trimmed, then |alias, #anchor and .md dropped. wiki://w/s names
    its wiki. A null or empty slug gives null. Each step is a column of its own,
    so that nothing is computed twice.
    """
    rows = rows.withColumn("_t", F.trim(entry))
    rows = rows.withColumn("_w", F.when(F.col("_t").startswith("wiki://"), F.regexp_extract("_t", r"^wiki://([^/]+)/", 1)).otherwise(""))
    rest = F.when(F.col("_w") != "", F.substring(F.col("_t"), F.length("_w") + 9, F.length("_t"))).otherwise(F.col("_t"))
    rows = rows.withColumn("_s", F.trim(F.rtrim(F.substring_index(F.substring_index(rest, "|", 1), "#", 1), F.lit(" \t\n\r\f\x0b"))))
    rows = rows.withColumn("_s", F.when(F.col("_s").endswith(".md"), F.substring(F.col("_s"), F.lit(1), F.length("_s") - 3)).otherwise(F.col("_s")))
    wiki = F.when(F.col("_w") != "", F.col("_w")).otherwise(F.coalesce(own_wiki, F.lit("")))
    return rows.withColumn("key", F.when(F.col("_s") != "", F.concat(wiki, F.lit("\0"), "_s"))).drop("_t", "_w", "_s")


def page_rows(pages: DataFrame) -> DataFrame:
    """The page table without its texts, read once and kept: one row for each page record (field null), and one for each distinct (rev_id, field, target) of its body_links and reference fields, with the key it names."""
    base = ["rev_id", "wiki", "type", "indexed_at"]
    empty = F.array().cast("array<string>")
    values = {"body_links": F.col("body_links")} | {name: F.try_element_at(F.col("fields"), F.lit(name)) for name in FIELD_KEYS}
    tagged = lambda name: lambda x: F.struct(F.lit(name).alias("field"), x.alias("target"))
    # distinct as strings, field by field: structs would be compared pair by pair
    entries = [F.transform(F.array_distinct(F.coalesce(v, empty)), tagged(name)) for name, v in values.items()]
    own = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("slug").alias("target")))
    rows = pages.select(*base, F.explode(F.concat(own, *entries)).alias("e")).select(*base, "e.field", "e.target")
    rows = with_key(rows.filter(F.col("target").isNotNull()), "target", F.when(F.col("field") != "body_links", F.col("wiki")))
    return cut_lineage(rows.withColumn("period", period(F.col("indexed_at")))).filter(F.col("field").isNull() | F.col("key").isNotNull())


def period(ts: Column) -> Column:
    """Month as year * 12 + month; null is 0."""
    return F.coalesce(F.year(ts) * 12 + F.month(ts), F.lit(0)).cast("int")


def page_facts(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Per key of a page: first indexed_at, type of the newest revision, whether the last change is a deletion; rows are those of page_rows().

    Every page gives two keys, one with its wiki and one for any wiki. Ties of
    changed_at go to the larger change_id.
    """
    change = "struct<changed_at:timestamp,change_id:bigint,status:string>"
    came = rows.filter(F.col("field").isNull()).select("wiki", F.col("target").alias("slug"), "indexed_at", "type", F.struct("indexed_at", "rev_id").alias("at"), F.lit(None).cast(change).alias("c"))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^wiki/", ""), r"\.md$", ""), r"/index$", "")
    changed = changes.filter(F.col("path").isNotNull()).select("wiki", slug.alias("slug"), F.struct(F.col("changed_at").cast("timestamp").alias("changed_at"), F.col("change_id").cast("long").alias("change_id"), "status").alias("c"))
    # aggregated per page first: late deliveries and repeats never reach the second, skewed level
    known = (
        came.unionByName(changed, allowMissingColumns=True)
        .groupBy(F.coalesce(F.col("wiki"), F.lit("")).alias("wiki"), "slug")
        .agg(F.min("indexed_at").alias("first_at"), F.max_by("type", "at").alias("t_type"), F.max("at").alias("last"), F.max("c").alias("c"))
    )
    both = F.explode(F.array(F.concat("wiki", F.lit("\0"), "slug"), F.concat(F.lit("\0"), "slug")))
    per = known.select(both.alias("key"), "first_at", "t_type", "last", "c").groupBy("key").agg(F.min("first_at").alias("first_at"), F.max_by("t_type", "last").alias("t_type"), F.max("last").alias("last"), F.max("c").alias("c"))
    return per.filter(F.col("last").isNotNull()).select("key", "first_at", "t_type", (F.coalesce(F.col("c.status"), F.lit("")) == "D").alias("gone"))


# Declarations of allowed target types, at most; they belong to the schemas, and more than this is an error.
MOST_DECLS = 100_000


def allowed_types(decls: DataFrame) -> dict[tuple[str, str], frozenset]:
    """(row type, field) -> target types, where some are listed."""
    rows = decls.filter(F.size(F.coalesce("target_types", F.array().cast("array<string>"))) > 0).select("type", "field", "target_types").distinct().limit(MOST_DECLS + 1).collect()
    if len(rows) > MOST_DECLS:
        raise ValueError(f"more than {MOST_DECLS} declarations")
    out: dict[tuple[str, str], frozenset] = {}
    for r in rows:
        out[r.type, r.field] = out.get((r.type, r.field), frozenset()) | frozenset(r.target_types)
    return out


SUSPECTS = "key string, period int, kind string, ref_field string, n long, first_at {time}, gone boolean, absent boolean, misfit boolean"


def _suspects_of(allowed: dict[tuple[str, str], frozenset]):
    """Suspects of one key range: its dictionary, its bitmaps, and reference AND-NOT parent for each kind."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        column = lambda name: t.column(name).combine_chunks() if t.num_rows else t.column(name)
        coded = column("key").dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        in_order = pc.sort_indices(coded.dictionary).to_numpy()
        rank[in_order] = np.arange(len(rank))
        ordinal = rank[coded.indices.to_numpy()]
        keys = coded.dictionary.take(pa.array(in_order))
        is_page = pc.is_null(column("ref_field")).to_numpy(zero_copy_only=False)
        month = column("period").to_numpy()
        types = column("type").dictionary_encode()
        type_names, type_code = types.dictionary.to_pylist(), types.indices.to_numpy()
        # parents, from pages alone
        pages = np.flatnonzero(is_page)
        gone = column("gone").fill_null(False).to_numpy(zero_copy_only=False)
        deleted = Bitmap.of(ordinal[pages[gone[pages]]])
        months = np.unique(month[pages])
        before, came = {}, Bitmap({})  # before[m]: not deleted, and first came before month m
        for m in np.unique(month[~is_page]):
            before[int(m)] = None
        waiting = sorted(before)
        for m in months:
            while waiting and waiting[0] <= m:
                before[waiting.pop(0)] = came
            came = came | Bitmap.of(ordinal[pages[month[pages] == m]]).minus(deleted)
        for m in waiting:
            before[m] = came
        wrong: dict[frozenset, Bitmap] = {}
        parents: dict[tuple, Bitmap] = {}

        def parent(m: int, types: frozenset | None) -> Bitmap:
            """Good parents of a kind: there in an earlier month, not deleted, of an allowed type."""
            if types is None:
                return before[m]
            if types not in wrong:
                wrong[types] = Bitmap.of(ordinal[pages[~np.isin(type_code[pages], [k for k, name in enumerate(type_names) if name in types])]])
            if (m, types) not in parents:
                parents[m, types] = before[m].minus(wrong[types])
            return parents[m, types]

        # references: one bitmap a kind
        refs = np.flatnonzero(~is_page)
        fields = column("ref_field").dictionary_encode()
        field_names, field_code = fields.dictionary.to_pylist(), fields.indices.fill_null(0).to_numpy()
        order = refs[np.lexsort((ordinal[refs], field_code[refs], type_code[refs], month[refs]))]
        same = (np.diff(month[order]) == 0) & (np.diff(type_code[order]) == 0) & (np.diff(field_code[order]) == 0)
        rows = []
        for kind in np.split(order, np.flatnonzero(~same) + 1) if len(order) else []:
            m, kt, kf = int(month[kind[0]]), type_names[type_code[kind[0]]], field_names[field_code[kind[0]]]
            left = Bitmap.of(ordinal[kind]).minus(parent(m, allowed.get((kt, kf)))).ordinals()
            rows.append(kind[np.searchsorted(ordinal[kind], left)])
        found = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        # what the range knows of each suspect key
        page_of = np.full(len(keys), -1, np.int64)
        page_of[ordinal[pages]] = pages
        at = page_of[ordinal[found]]
        absent = at < 0
        take = pa.array(np.where(absent, 0, at))
        first_at = pc.if_else(pa.array(absent), None, column("first_at").take(take))
        fit = [a or allowed.get((type_names[type_code[f]], field_names[field_code[f]])) is None or type_names[type_code[p]] in allowed[type_names[type_code[f]], field_names[field_code[f]]] for f, p, a in zip(found, at, absent)]
        out = [keys.take(pa.array(ordinal[found])), pa.array(month[found], pa.int32()), types.take(pa.array(found)).cast(pa.string()), fields.take(pa.array(found)).cast(pa.string()), column("n").take(pa.array(found)), first_at]
        out += [pa.array(np.where(absent, False, gone[at])), pa.array(absent), pa.array([not x for x in fit], pa.bool_())]
        return pa.table(dict(zip(("key", "period", "kind", "ref_field", "n", "first_at", "gone", "absent", "misfit"), out)))

    return run


def suspects(rows: DataFrame, changes: DataFrame, decls: DataFrame, ranges: int) -> DataFrame:
    """(key, period, kind, ref_field, n, first_at, gone, absent, misfit): the decoded bits of reference AND-NOT parent, with what is known of their key.

    A parent bit is set for a kind (period, row type, field) if the page exists,
    is not deleted, first came in an earlier month, and has an allowed type. What
    stays is every reference that may be faulty; none that is faulty is lost.
    """
    blank = F.coalesce("type", F.lit("")).alias("type")
    kinds = rows.filter(F.col("field").isNotNull()).select("key", "period", blank, F.col("field").alias("ref_field")).groupBy("key", "period", "type", "ref_field").agg(F.count(F.lit(1)).alias("n"))
    facts = page_facts(rows, changes).select("key", period(F.col("first_at")).alias("period"), F.coalesce("t_type", F.lit("")).alias("type"), "first_at", "gone")
    both = kinds.unionByName(facts, allowMissingColumns=True).withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    return both.repartition(ranges, "range").groupBy("range").applyInArrow(_suspects_of(allowed_types(decls)), SUSPECTS.format(time=rows.schema["indexed_at"].dataType.simpleString()))


BYTES_PER_RANGE = 64 << 20


def faulty_references(pages: DataFrame, changes: DataFrame, decls: DataFrame) -> DataFrame:
    """(rev_id, wiki, indexed_at, field, target, reason) of every faulty reference; reason is the first of missing, deleted, late, wrong-type."""
    ranges = max(2 * parallelism(pages.sparkSession), estimated_bytes(pages) // BYTES_PER_RANGE)
    rows = page_rows(pages)
    found = cut_lineage(suspects(rows, changes, decls, ranges))
    # suspects are one row a kind, not one row a reference, and know how many references they stand for
    kind = ["key", "period", "kind", "ref_field"]
    side = rows.filter(F.col("field").isNotNull()).withColumns({"kind": F.coalesce("type", F.lit("")), "ref_field": F.col("field")})
    joined = salted_join(side, found.drop("n"), kind, "rev_id", counts=found.select(*kind, F.col("n").alias("_n")))
    reason = F.when(F.col("absent"), "missing").when(F.col("gone"), "deleted").when(F.col("first_at") > F.col("indexed_at"), "late").when(F.col("misfit"), "wrong-type")
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("rev_id", "wiki", "indexed_at", "field", "target", "reason")


def orphan_report(faulty: DataFrame) -> DataFrame:
    """Faulty references counted per field, month of indexed_at and reason."""
    return faulty.groupBy("field", F.date_format(F.date_trunc("month", "indexed_at"), "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_refs"))


def brute_force(pages: list[dict], changes: list[dict], decls: list[dict]) -> Iterator[tuple]:
    """The same result by plain loops, for tests on small fixtures."""
    import re

    first: dict = {}
    kinds: dict = {}
    for p in sorted(pages, key=lambda p: (p["indexed_at"], p["rev_id"])):
        for key in ((p["wiki"], p["slug"]), (None, p["slug"])):
            first.setdefault(key, p["indexed_at"])
            kinds[key] = p["type"]
    gone: dict = {}
    for c in sorted(changes, key=lambda c: (c["changed_at"], c["change_id"])):
        slug = re.sub(r"/index$", "", re.sub(r"\.md$", "", re.sub(r"^wiki/", "", c["path"])))
        for key in ((c["wiki"], slug), (None, slug)):
            gone[key] = c["status"] == "D"
    allow = {(d["type"], d["field"]): d["target_types"] for d in decls if d["target_types"]}
    for p in pages:
        listed = [("body_links", t) for t in p["body_links"] or []]
        for name in FIELD_KEYS:
            listed += [(name, t) for t in (p["fields"] or {}).get(name) or []]
        for field, target in dict.fromkeys(listed):
            if target is None:
                continue
            m = re.match(r"wiki://([^/]+)/(.*)$", target.strip(), re.S)
            slug = re.sub(r"\.md$", "", re.sub(r"[|#].*$", "", m[2] if m else target.strip(), flags=re.S).strip())
            if not slug:
                continue
            key = (m[1] if m else None if field == "body_links" else p["wiki"], slug)
            ok = allow.get((p["type"], field))
            why = "missing" if key not in first else "deleted" if gone.get(key) else "late" if first[key] > p["indexed_at"] else "wrong-type" if ok and kinds[key] not in ok else None
            if why:
                yield p["rev_id"], field, target, why
