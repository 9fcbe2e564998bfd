"""Document fingerprints: Merkle trees over paragraphs and sections, by SQL functions only.

A text is cut at line ends into paragraphs; runs of paragraphs form sections. Where a section ends is told by
the digest of its last paragraph, so that an inserted paragraph disturbs its own section and no other. A paragraph's node is the digest of
its text, a section's node the digest of its paragraphs' nodes, the root that of the sections' nodes: equal roots mean equal
texts, and where roots differ only sections, and then paragraphs, that differ need to be looked at. The leaves below a paragraph are the digests of
its short pieces, whose ends are told by their letters; ``likeness`` walks two trees from their roots and counts the leaves that are left.

A null text is the empty text, which has one empty paragraph. Repeated rows each get a fingerprint. Further columns stay as they are; the names
that are added are stated where they are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Up to the first space after one of these letters, or 48 characters.
PIECE = r"[^\n]{0,47}?[desntr.,] |[^\n]{1,48}"
DIGEST, LEAF = 64, 16  # hex digits
SECTION_ENDS = "0123"  # first hex digits of a paragraph digest that end a section: one in four
BLOCK_BYTES = 4 << 20
MAX_BLOCKS = 1 << 16
LEAST = -(1 << 63)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``<name>``: struct<root, sections, paragraphs, branches, n_leaves> of the column ``text``.

    A branch is a section for the walk: its paragraphs, each its digest and those of its leaves in a row, with commas after them."""
    paragraphs, nodes, sections = (f"_{name}_{x}" for x in ("text", "nodes", "sections"))
    grown = f"_{name}_grown"
    ends = F.lit(SECTION_ENDS)
    marked = F.transform(nodes, lambda h: F.when(ends.contains(F.substring(h, 1, 1)), F.concat(h, F.lit("|"))).otherwise(h))

    def with_leaves(h: Column, p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.lpad(F.hex(F.xxhash64(x)), LEAF, "0"))
        return F.concat(h, F.array_join(leaves, ""), F.when(ends.contains(F.substring(h, 1, 1)), F.lit("|")).otherwise(F.lit(",")))

    return (
        df.withColumn(paragraphs, F.split(F.coalesce(text, F.lit("")), "\n"))
        .withColumn(nodes, F.transform(paragraphs, lambda p: F.sha2(p, 256)))
        .withColumn(
            sections,
            F.transform(F.filter(F.split(F.array_join(marked, ""), r"\|"), lambda s: s != ""), lambda s: F.sha2(s, 256)),
        )
        .withColumn(grown, F.array_join(F.zip_with(nodes, paragraphs, with_leaves), ""))
        .withColumn(
            name,
            F.struct(
                F.sha2(F.array_join(sections, ""), 256).alias("root"),
                F.col(sections).alias("sections"),
                F.col(nodes).alias("paragraphs"),
                F.filter(F.split(grown, r"\|"), lambda s: s != "").alias("branches"),
                ((F.char_length(grown) - (DIGEST + 1) * F.size(nodes)) / LEAF).cast("long").alias("n_leaves"),
            ),
        )
        .drop(paragraphs, nodes, sections, grown)
    )


def fingerprint(tree: str) -> Column:
    """Root and the first digits of each section: equal for equal texts only."""
    return F.concat_ws(":", F.col(f"{tree}.root"), F.array_join(F.transform(f"{tree}.sections", lambda h: F.substring(h, 1, 8)), ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: a column that a lambda names would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(items: Column) -> Column:
    """The texts in order, each repeat with its number behind ``#``: sets of them have the repeats of the list."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.flatten(F.transform(at, lambda b, k: repeats(F.get(s, b), F.coalesce(F.get(at, k + 1), n) - b))))

    def repeats(x: Column, times: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), times - 1), lambda j: F.when(j == 0, x).otherwise(F.concat(x, F.lit("#"), j.cast("string"))))

    return let(F.sort_array(items), runs)  # compares bytes, where array_sort calls a lambda


def below(gone: Column, children: Callable[[Column], Column]) -> Column:
    """The children of nodes, which are numbered where they repeat."""
    return F.filter(F.flatten(F.transform(gone, lambda x: children(F.substring_index(x, "#", 1)))), lambda c: c != "")


def shared_leaves(a: str, b: str) -> Column:
    """Leaves of the branches that only one of two trees has, as far as the other has them elsewhere, plus those of common branches: the
    walk goes from sections to paragraphs to leaves, and below differing nodes only; a node counts as often as both trees have it."""

    def walk(x: Column, y: Column, levels: list[Callable[[Column], Column]]) -> Column:
        """Leaves that are in ``x`` but have no partner in ``y``."""

        def pair(sides: Column) -> Column:
            left, right = F.array_except(F.get(sides, 0), F.get(sides, 1)), F.array_except(F.get(sides, 1), F.get(sides, 0))
            if not levels:
                return F.size(left)
            return walk(below(left, levels[0]), below(right, levels[0]), levels[1:])

        return let(F.array(numbered(x), numbered(y)), pair)

    paragraphs = lambda section: F.split(section, ",")
    leaves = lambda node: F.regexp_extract_all(F.substring(node, DIGEST + 1, 1 << 30), F.lit("[0-9A-F]{%d}" % LEAF), F.lit(0))
    return F.col(f"{a}.n_leaves") - walk(F.col(f"{a}.branches"), F.col(f"{b}.branches"), [paragraphs, leaves])


def likeness(a: str, b: str) -> Column:
    """Share of leaves that two trees have in common, 0 to 1, repeats counted; 1 for equal roots without looking further, and below
    1 for others: n leaves that only stand in another order give n / (n + 1). Texts of line ends only have no leaves and are alike if equal."""
    both = F.col(f"{a}.n_leaves") + F.col(f"{b}.n_leaves")
    part = F.least(2 * shared_leaves(a, b) / both, both / (both + 1))
    return F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), 1.0).when(both == 0, 0.0).otherwise(part)


def edits(a: str, b: str) -> Column:
    """struct<sections, left, right>: number of sections of ``a`` that ``b`` lacks, and the places (from 0) of the
    paragraphs of ``a`` that ``b`` lacks and of those of ``b`` that ``a`` lacks; empty for equal roots."""

    def lacking(x: str, y: str) -> Column:
        gone = F.array_except(f"{x}.paragraphs", f"{y}.paragraphs")
        at = F.sequence(F.lit(0), F.size(f"{x}.paragraphs") - 1)
        return F.filter(at, lambda i: F.array_contains(gone, F.get(F.col(f"{x}.paragraphs"), i)))

    none, same = F.array().cast("array<int>"), F.col(f"{a}.root") == F.col(f"{b}.root")
    return F.struct(
        F.when(same, 0).otherwise(F.size(F.array_except(f"{a}.sections", f"{b}.sections"))).alias("sections"),
        F.when(same, none).otherwise(lacking(a, b)).alias("left"),
        F.when(same, none).otherwise(lacking(b, a)).alias("right"),
    )


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, next_text): the text of the row that follows in descending key order; the first follows the last.

    Null keys come last, equal keys are ordered by text. Rows go to key ranges of about ``BLOCK_BYTES``, found from
    approximate quantiles, and are ordered within them; each range also gets the first row of the range after it."""
    rows = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("text")).withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(LEAST)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = min(MAX_BLOCKS, max(1, -(-size // BLOCK_BYTES)))
    bounds = []
    if blocks > 1:
        fractions = [k / blocks for k in range(1, blocks)]
        bounds = sorted(set(rows.agg(F.percentile_approx("_key", fractions, max(10_000, 4 * blocks)).alias("q")).first()["q"]))
    values = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)))

    def jump(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(values, at + step - 1) <= F.col("_key"), F.lit(False)), at + step).otherwise(at)

    block = F.aggregate(steps, F.lit(0), jump) if bounds else F.lit(0)
    placed = rows.withColumn("_block", block)
    heads = sorted((r["_block"], r["k"]) for r in placed.groupBy("_block").agg(F.max("_key").alias("k")).collect())  # a row for each range
    after = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    if after:
        to = F.element_at(F.create_map(*(F.lit(x) for pair in after.items() for x in pair)), F.col("_key"))
        first = F.col(key).isin([k for k in after if k != LEAST]) | F.col(key).isNull()
        copies = rows.filter(first & F.col("_key").isin(list(after))).withColumn("_block", to)
        placed = placed.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    else:
        placed = placed.withColumn("_copy", F.lit(False))
    order = Window.partitionBy("_block").orderBy("_copy", F.desc("_key"), "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).filter(~F.col("_copy")).select(key, "text", "next_text")


def with_edit(pairs: DataFrame) -> DataFrame:
    """Adds n_chars and edited: the last third of the text replaced by the first as many code points of next_text."""
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    return pairs.withColumns(
        {"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))}
    )
