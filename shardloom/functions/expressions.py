"""Row expressions: paths, captions, geometry, terms, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.draws import draw

# Term lists, limits and template words that prompts are made of.
VOCABULARY = {
    "texture": ("horizontal lines", "horizontal stripes", "vertical lines", "parallel lines", "striped", "grooves", "grainy", "granular", "fine texture", "rough", "smooth", "brushed", "uniform", "noisy"),
    "illumination": ("even lighting", "uniform lighting", "low contrast", "high contrast", "bright", "dark", "shadow", "reflective", "glossy", "matte"),
    "shape": ("thin", "thick", "long", "short", "straight", "curved", "diagonal", "linear", "elongated", "small", "large", "round", "circular", "oval", "irregular", "blob", "dot", "speck", "cluster", "streak", "line", "patch"),
}
TERM_LIMITS = {"texture": 2, "illumination": 1, "shape": 3}
MAX_DESCRIPTION_CHARS, MAX_PROMPT_CHARS = 1500, 300
SINGULAR = {"scratches": "scratch", "spots": "spot"}
SIGMAS = (0.1, 0.3, 0.5, 0.7, 0.9)


def parse_path(path, ok: str, nok: str) -> Column:
    """STRUCT<product, label, official_split, ok> of a path.

    ok: pattern with groups (product, product); nok: (product, split, class, product, abbreviation, split).  A path whose
    fields contradict each other, or that fits neither, has ok = false and null fields.
    """
    o = [F.regexp_extract(path, ok, i) for i in (1, 2)]
    n = [F.regexp_extract(path, nok, i) for i in range(1, 7)]
    good = path.rlike(ok) & (o[0] == o[1])
    bad = path.rlike(nok) & (n[0] == n[3]) & (n[1] == n[5]) & (n[4] == F.substring(n[2], 1, 2))
    pick = lambda a, b: F.when(good, a).when(bad, b)
    return F.struct(pick(o[0], n[0]).alias("product"), pick(F.lit("normal"), n[2]).alias("label"), pick(F.lit(""), n[1]).alias("official_split"), F.coalesce(good | bad, F.lit(False)).alias("ok"))


def crop_geometry(width, height, side: int) -> Column:
    """STRUCT of the reported size, the crop offsets and whether the image is centre-cropped; halves round to even."""
    scale = F.lit(float(side)) / F.least(width, height)
    w, h = F.bround(width * scale).cast("long"), F.bround(height * scale).cast("long")
    left, top = (F.floor((F.greatest(F.lit(side), x) - side) / 2).cast("long") for x in (w, h))
    return F.struct(w.alias("width"), h.alias("height"), left.alias("left"), top.alias("top"), (width != height).alias("centre_cropped"))


def letterbox_geometry(width, height, side: int) -> Column:
    """STRUCT of the size and offsets after scaling the longer side to `side` and centring."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    w, h = (F.greatest(F.lit(1), F.bround(x * scale)).cast("long") for x in (width, height))
    return F.struct(w.alias("width"), h.alias("height"), F.floor((side - w) / 2).cast("long").alias("left"), F.floor((side - h) / 2).cast("long").alias("top"))


def content_digest(shape, content) -> Column:
    """SHA-256 of decoded content behind its shape, so equal bytes of another shape differ."""
    return F.sha2(F.concat(shape.cast("string").cast("binary"), F.lit("|").cast("binary"), content.cast("binary")), 256)


def normalised_text(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def view_params(rows: DataFrame, key: str, seed: int, views: int = 4) -> DataFrame:
    """key, view, hflip, brightness, contrast: label-preserving transforms, whatever the row order."""
    at = F.col("view")
    shade = lambda what: F.round(0.9 + 0.2 * draw(what, seed, F.col(key), at), 4)
    return rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view")).select(
        key, at.cast("long").alias("view"), (draw("hflip", seed, F.col(key), at) < 0.5).alias("hflip"), shade("brightness").alias("brightness"), shade("contrast").alias("contrast")
    )


def terms_in(text, terms: tuple[str, ...], limit: int) -> Column:
    """Terms of the list that stand in a text between non-letters, in the list's order, at most `limit`."""
    low = F.lower(text)
    hit = lambda t: F.when(low.rlike(rf"(?<![a-z]){t}(?![a-z])"), F.lit(t))
    return F.slice(F.array_compact(F.array(*map(hit, terms))), 1, limit)


def extract_terms(text) -> Column:
    """STRUCT of the terms of each category; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(*[terms_in(text, terms, TERM_LIMITS[c]).alias(c) for c, terms in VOCABULARY.items()])


def description_problems(text, need: tuple[str, ...]) -> Column:
    """Problems of a description as an array; empty if it can be used."""
    # The texts of the problems.
    empty = text.isNull() | (F.trim(text) == "")
    terms = extract_terms(text)
    none = F.lit(True)
    for c in need:
        none = none & (F.size(terms[c]) == 0)
    return F.when(empty, F.array(F.lit("empty description"))).otherwise(
        F.array_compact(F.array(
            F.when(F.length(text) > MAX_DESCRIPTION_CHARS, F.lit(f"longer than {MAX_DESCRIPTION_CHARS} characters")),
            F.when(none, F.lit(f"no whitelisted {'/'.join(need)} term")),
        ))
    )


def humanise_label(label) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SINGULAR.items() for x in pair])
    return F.coalesce(F.try_element_at(known, label), F.replace(label, F.lit("_"), F.lit(" ")))


def noise_mix(rows: DataFrame, key: str, vector: str, seed: int) -> DataFrame:
    """key, sigma, mixed, target: (1 - s) x + s e and e - x for every noise level; e in [-1, 1) is drawn once per part."""
    e = F.transform(vector, lambda x, i: 2 * draw("noise", seed, F.col(key), i) - 1)
    leveled = rows.select(key, F.col(vector).alias("_x"), e.alias("_e")).select("*", F.explode(F.array(*map(F.lit, SIGMAS))).alias("sigma"))
    s = F.col("sigma")
    return leveled.select(
        key, "sigma", F.zip_with("_x", "_e", lambda x, n: (1 - s) * x + s * n).alias("mixed"), F.zip_with("_x", "_e", lambda x, n: n - x).alias("target")
    )


def interval_side(low, high) -> Column:
    return F.when(low > 0, "above zero").when(high < 0, "below zero").when(low.isNotNull() & high.isNotNull(), "includes zero")


def stop_reason(tokens, end_ids: list[int], limit: int) -> Column:
    last = F.try_element_at(tokens, F.lit(-1))
    return F.when(last.isin(end_ids), "end_of_sequence").when(F.size(tokens) >= limit, "max_new_tokens").otherwise("other")


def source_urls(base: str, page: str, photo, ext, item) -> Column:
    """STRUCT<object_url, page_url>; the object url is null for an extension outside jpg and jpeg."""
    return F.struct(
        F.when(F.lower(ext).isin("jpg", "jpeg"), F.concat(F.lit(base + "/"), photo.cast("string"), F.lit("/medium."), F.lower(ext))).alias("object_url"),
        F.concat(F.lit(page + "/"), item.cast("string")).alias("page_url"),
    )


def captions_from_labels(rows: DataFrame, names: DataFrame, label: str, template: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a caption, rows of an unknown label).  names: label and the columns of the template, one row a label."""
    known = rows.join(names, label)
    caption = F.expr(f"format_string('{template}', {', '.join(c for c in names.columns if c != label)})")
    return known.withColumn("caption", caption), rows.join(names, label, "left_anti")


def text_signature(rows: DataFrame, key: str, text: str, bins: int = 256, out: str = "signature") -> DataFrame:
    """key and a vector of hashed token counts, centred and of unit length, for every row; a text without tokens has no row.

    One Arrow pass counts and hashes a text's tokens where the text is; nothing is shuffled.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    kind = rows.schema[key].dataType.simpleString()

    class Bins(dict):
        """The bin of a token; no token has one beyond the last."""

        def __missing__(self, token):
            if len(self) >= 1 << 17:
                self.clear()
            self[token] = b = int(hashlib.sha256(token.encode()).hexdigest()[:8], 16) % bins if token else bins
            return b

    def dense(batches):
        bin_of = Bins().__getitem__
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                x = np.zeros((batch.num_rows, bins))
                for r, t in enumerate(batch.column(1).to_pylist()):
                    if t:
                        tokens = t.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
                        x[r] = np.bincount(np.fromiter(map(bin_of, tokens), np.int64, len(tokens)), minlength=bins + 1)[:bins]
                full = x.any(axis=1)
                x = x[full] - x[full].mean(axis=1, keepdims=True)
                length = np.sqrt((x**2).sum(axis=1, keepdims=True))
                x = np.where(length > 1e-6, x / np.maximum(length, 1e-6), 0.0)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * bins, pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(full)), vectors], names=[key, out])

    # Cutting at every blank and leaving out empty tokens gives those of `normalised_text`.
    return rows.select(key, F.lower(F.col(text)).alias("_t")).mapInArrow(dense, f"`{key}` {kind}, `{out}` array<double>")
