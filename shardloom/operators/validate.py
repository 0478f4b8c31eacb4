"""Validators: every broken rule of every row is kept as data; the smallest rule_order is the first refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.operators.prefix import running_sums
from shardloom.operators.provenance import dataset_digest

# The patterns of ids (and groups) and of class names.
ID_PATTERN = r"^[A-Za-z0-9._-]{1,128}$"
CLASS_PATTERN = r"^[a-z][a-z0-9_]{0,31}$"
#: Entries of archives that a task sorts at once.
RANGE_ROWS = 1 << 18


def violations(rows: DataFrame, key: str, rules: list[tuple[str, Column, Column | str]]) -> DataFrame:
    """key, rule_order, rule, message of every rule that a row breaks.  rules: (name, broken?, message)."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(i).alias("rule_order"), F.lit(name).alias("rule"), (message if isinstance(message, Column) else F.lit(message)).alias("message")))
        for i, (name, broken, message) in enumerate(rules)
    ]))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("v")).select("key", "v.rule_order", "v.rule", "v.message")


def first_refusal(found: DataFrame) -> DataFrame:
    """key, rule, message of the first broken rule of every key."""
    return found.groupBy("key").agg(F.min_by(F.struct("rule", "message"), "rule_order").alias("v")).select("key", "v.rule", "v.message")


def stripped(c) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def with_copies(rows: DataFrame, id_col: str, salts: int = 16) -> DataFrame:
    """The rows with _copies, how many rows share their id (null and '' are ids as well).

    Ids are counted by partial aggregation and only repeated ones are joined, each to `salts` places, so rows of a frequent id are not one task's; blank
    ids, which may be most rows, join nothing.
    """
    blank = F.coalesce(F.col(id_col).cast("string") == "", F.lit(True))
    n = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    blanks = n.where(blank).agg(F.sum(F.when(F.col(id_col).isNull(), F.col("_n"))).alias("_null"), F.sum(F.when(F.col(id_col).isNotNull(), F.col("_n"))).alias("_empty"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    twice = n.where(~blank & (F.col("_n") > 1)).select(F.col(id_col).alias("_id"), "_n", spread.alias("_salt"))
    keyed = rows.withColumn("_key", F.when(~blank, F.col(id_col))).withColumn("_place", F.pmod(F.spark_partition_id(), F.lit(salts)))
    joined = keyed.join(twice, (F.col("_key") == F.col("_id")) & (F.col("_place") == F.col("_salt")), "left").join(F.broadcast(blanks))  # one row
    copies = F.when(F.col(id_col).isNull(), F.col("_null")).when(blank, F.col("_empty")).otherwise(F.coalesce("_n", F.lit(1)))
    return joined.select(*rows.columns, copies.alias("_copies"))


def with_many(rows: DataFrame, by: list[str], name: str, above: int, salts: int = 16) -> DataFrame:
    """The rows with `name`: how many rows share their values of `by` (null is a value as well), where these are more than `above`; else null.

    Counts come from partial aggregation; only those above are joined, each to `salts` places, so rows of a frequent value are not one task's, and from a hash table, so the rows are not sorted.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > above).select(*[F.col(c).alias(f"_by_{c}") for c in by], name, spread.alias("_salt"))
    same = F.col("_place") == F.col("_salt")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = rows.withColumn("_place", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return placed.join(many.hint("shuffle_hash"), same, "left").select(*rows.columns, name)


def record_rules(rows: DataFrame, id_col: str, caption: str, width: str, height: str, image: str | None = None) -> tuple[DataFrame, list]:
    """Rows with a copy count, and the rules of a captioned record in the order in which they refuse it.

    `image` (optional) names a column that is null where the image is missing.  All copies of an id break its rule.
    """
    counted = with_copies(rows, id_col)
    i, c, w, h = map(F.col, (id_col, caption, width, height))
    return counted, [
        ("id", i.isNull() | (i.cast("string") == "") | (F.length(i.cast("string")) > 64), "id must have 1 to 64 characters"),
        ("image", F.col(image).isNull() if image else F.lit(False), "image not found"),
        ("side", (F.least(w, h) < 256) | (F.greatest(w, h) > 4096) | w.isNull() | h.isNull(), "sides must be 256 to 4096"),
        ("caption", c.isNull() | (stripped(c) == "") | (F.length(c) > 1000), "caption must have 1 to 1000 characters and not be blank"),
        ("unique_id", F.col("_copies") > 1, "id must be unique"),
    ]


def validate_records(rows: DataFrame, id_col: str, caption: str, width: str, height: str, image: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows with trimmed captions, violations)."""
    counted, rules = record_rules(rows, id_col, caption, width, height, image)
    broken = F.lit(False)
    for _, b, _ in rules:
        broken = broken | F.coalesce(b, F.lit(False))
    return counted.where(~broken).drop("_copies").withColumn(caption, stripped(F.col(caption))), violations(counted, id_col, rules)


def count_refusal(rows: DataFrame, what: str = "records", minimum: int = 4, maximum: int | None = 2000) -> DataFrame:
    """n, message if the number of rows is outside the limits; no row otherwise."""
    n = F.col("n")
    bad = (n < minimum) | ((n > maximum) if maximum is not None else F.lit(False))
    limits = f"{minimum} to {maximum}" if maximum is not None else f"at least {minimum}"
    return rows.agg(F.count(F.lit(1)).alias("n")).where(bad).select("n", F.concat(n.cast("string"), F.lit(f" {what}; {limits} are required")).alias("message"))


def validate_prompts(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(trimmed prompts, violations); duplicates are allowed.  No prompt at all is refused by `count_refusal(rows, "prompts", 1, None)`."""
    t = stripped(F.col(text))
    rules = [("blank", F.col(text).isNull() | (t == ""), "prompt must not be blank"), ("length", F.length(text) > 1000, "prompt must have at most 1000 characters")]
    good = ~F.coalesce(rules[0][1] | rules[1][1], F.lit(True))
    return rows.where(good).withColumn(text, t), violations(rows, key, rules)


def dataset_report(rows: DataFrame, caption: str, width: str, height: str, digest_of: list[str]) -> DataFrame:
    """One row: counts, sides, how many are cropped, and the digest over the columns `digest_of` (id, content digest, caption)."""
    side = F.least(width, height)
    report = rows.agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct(caption).alias("n_captions"), F.min(side).alias("shorter_min"), F.max(side).alias("shorter_max"),
        F.count_if(F.col(width) != F.col(height)).alias("centre_cropped"),
    )
    return report.join(dataset_digest(rows, digest_of).select("digest"), how="left")  # one row each; no rows have no digest


def archive_rules(entries: DataFrame, *, max_entries: int, max_member: int, max_total: int, suffixes: tuple[str, ...]) -> tuple[DataFrame, list]:
    """Entries (archive, ord, name, size, is_symlink, encrypted) with running totals, and the rules of a safe archive.

    `ord` is any value that orders an archive's entries, a struct of several among them.  No archive is one task's: totals run along ranges, and entries and equal names are counted by partial aggregation.
    """
    summed = running_sums(entries, ["archive"], ["ord"], {"_before": "size"}, RANGE_ROWS)
    summed = summed.withColumn("_total", F.col("_before") + F.coalesce("size", F.lit(0))).drop("_before")
    counted = with_many(with_many(summed, ["archive", "name"], "_copies", 1), ["archive"], "_entries", max_entries)
    n = F.col("name")
    return counted, [
        ("entries", F.col("_entries") > max_entries, "too many entries"),
        ("symlink", F.col("is_symlink"), "symbolic link"),
        ("absolute", n.startswith("/") | n.rlike(r"^[A-Za-z]:") | n.contains("\\") | n.contains("\0"), "absolute or unusual path"),
        ("traversal", F.array_contains(F.split(n, "/"), ".."), "path leaves the archive"),
        ("duplicate", F.col("_copies") > 1, "duplicate name"),
        ("encrypted", F.col("encrypted"), "encrypted entry"),
        ("suffix", ~F.lower(F.regexp_extract(n, r"(\.[^./]*)$", 1)).isin(*suffixes), "unsupported suffix"),
        ("member_size", F.col("size") > max_member, "member too large"),
        ("total_size", F.col("_total") > max_total, "archive too large"),
    ]


def check_archive_entries(entries: DataFrame, **limits) -> DataFrame:
    counted, rules = archive_rules(entries, **limits)
    return violations(counted.withColumn("_key", F.concat_ws(":", "archive", F.col("ord").cast("string"))), "_key", rules)


def validate_user_manifest(rows: DataFrame, listing: DataFrame, *, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """Violations of a manifest (image_id, path, class, group) against the files that exist (path).

    Rules of the whole table (no rows, the set of classes) have a null key and come after those of the rows.
    """
    there = listing.select(F.col("path"), F.lit(True).alias("_there")).distinct()
    r = with_copies(rows.join(there, "path", "left"), "image_id")
    found = violations(r, "image_id", [
        ("id", ~F.coalesce(F.col("image_id").rlike(ID_PATTERN), F.lit(False)), "id has unusual characters"),
        ("unique_id", F.col("_copies") > 1, "id must be unique"),
        ("class", ~F.coalesce(F.col("class").rlike(CLASS_PATTERN), F.lit(False)), "class has unusual characters"),
        ("path", F.col("path").isNull() | F.col("path").startswith("/") | F.col("path").contains("\\") | F.array_contains(F.split("path", "/"), ".."), "path must be relative and stay inside"),
        ("exists", F.col("_there").isNull(), "file does not exist"),
        ("suffix", ~F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes), "unsupported suffix"),
        ("group", F.col("group").isNotNull() & (F.col("group") != "") & ~F.col("group").rlike(ID_PATTERN), "group has unusual characters"),
    ])
    empty = count_refusal(rows, "rows", 1, None).select(F.lit(None).cast("string").alias("key"), F.lit(7).alias("rule_order"), F.lit("empty").alias("rule"), "message")
    classes = class_set_refusal(rows, "class").select(F.lit(None).cast("string").alias("key"), F.lit(8).alias("rule_order"), F.lit("class_set").alias("rule"), "message")
    return found.unionByName(empty).unionByName(classes)


def class_set_refusal(rows: DataFrame, label: str, normal: str = "normal", defects: int = 2) -> DataFrame:
    """message if the classes are not `normal` and exactly `defects` others; no row otherwise, or for an empty table."""
    names = rows.select(label).distinct().agg(
        F.count_if(F.col(label) == normal).alias("_normal"), F.count_if(F.col(label) != normal).alias("_others"), F.count(F.lit(1)).alias("_n")
    )
    text = F.when(F.col("_normal") == 0, F.lit(f"a class named {normal} is required")).otherwise(
        F.concat(F.lit(f"exactly {defects} classes besides {normal} are supported; found "), F.col("_others").cast("string"))
    )
    return names.where((F.col("_n") > 0) & ((F.col("_normal") == 0) | (F.col("_others") != defects))).select(text.alias("message"))


def resolve_members(table: DataFrame, members: DataFrame, folder: str) -> DataFrame:
    """file, member, status: an exact path, else one relative to the table's folder, else the only member of that base name."""
    m = members.select(F.col("member")).distinct()
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    names = m.groupBy(base("member").alias("_base")).agg(F.min("member").alias("_named"), F.count(F.lit(1)).alias("_n"))
    exact = m.select(F.col("member").alias("_exact"))
    inside = m.select(F.col("member").alias("_inside"))
    both = (
        table.select("file").distinct().join(exact, F.col("file") == F.col("_exact"), "left")
        .join(inside, F.concat(F.lit(folder + "/"), "file") == F.col("_inside"), "left").join(names, base("file") == F.col("_base"), "left")
    )
    only = F.when(F.col("_n") == 1, F.col("_named"))
    found = F.coalesce("_exact", "_inside", only)
    return both.select("file", found.alias("member"), F.when(found.isNotNull(), "found").when(F.col("_n") > 1, "ambiguous").otherwise("missing").alias("status"))


def class_order(rows: DataFrame, label: str, normal: str = "normal") -> DataFrame:
    """label, n, class_index: `normal` first, then by descending count and name.  `class_set_refusal` tells whether the set is a valid one."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy((F.col(label) != normal).cast("int"), F.when(F.col(label) == normal, 0).otherwise(-F.col("n")), label)
    return n.withColumn("class_index", (F.row_number().over(order) - 1).cast("long"))


def validate_review(review: DataFrame, candidates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted ids, violations) of review rows (key, decision); ids of no candidate are ignored."""
    known = review.join(candidates.select(key), key, "left_semi")
    d = F.lower(F.trim("decision"))
    bad = violations(known, key, [("decision", ~F.coalesce(d.isin("accept", "reject", "uncertain"), F.lit(False)), F.concat(F.lit("unknown decision: "), F.coalesce("decision", F.lit("null"))))])
    return known.where(d == "accept").select(key).distinct(), bad


def verify_manifest(manifest: DataFrame, listing: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """path, status of every file of a manifest (path, bytes, sha256) or listing: the first mismatch, in the order of the rules."""
    l = listing.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_there"))
    both = manifest.withColumn("_listed", F.lit(True)).join(l, "path", "full_outer")
    ok = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)
    return both.select("path", F.when(F.col("_there").isNull(), "missing").when(F.col("_listed").isNull(), "not listed").when(F.col("bytes") != F.col("_bytes"), "size differs").when(F.col("sha256") != F.col("_sha256"), "digest differs").when(~ok, "type not allowed").otherwise("ok").alias("status"))


def verify_identity(manifest: DataFrame, expected: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """field, expected, found of every identity field (model, revision, staging source) of a manifest that is not as expected, for each of `by`, if given."""
    by = by or []
    found = manifest.select(*by, *[c for c in expected if c not in by]).distinct()
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(v).alias("expected"), F.col(k).cast("string").alias("found")) for k, v in expected.items()])
    return found.select(*by, F.explode(fields).alias("x")).select(*by, "x.*").where(~F.col("expected").eqNullSafe(F.col("found")))


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    return manifest.join(listing.select("path"), "path", "left_anti")


def verify_rows(rows: DataFrame, frozen: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose current digest is not the frozen one, or that were never frozen."""
    f = frozen.select(key, F.col(digest).alias("_frozen"))
    return rows.select(key, digest).join(f, key, "left").where(~F.col(digest).eqNullSafe(F.col("_frozen"))).select(key)


def compare_facts(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key, status where two (key, value) tables differ: missing, unexpected or different."""
    a = actual.select(key, F.col(value).alias("_actual"), F.lit(True).alias("_there"))
    both = expected.select(key, value, F.lit(True).alias("_wanted")).join(a, key, "full_outer")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_wanted").isNull(), "unexpected").when(~F.col(value).eqNullSafe(F.col("_actual")), "different")
    return both.select(key, status.alias("status")).where("status is not null")


def check_artifact(expected: DataFrame, actual: DataFrame, classes: DataFrame) -> DataFrame:
    """rule, key, status of an artifact's files (path, bytes, sha256) and classes (class, class_index).

    The set of files must be exact, and sizes and digests equal; classes must be unique and numbered 0 .. n - 1, and there must be some.
    """
    fact = F.concat_ws(":", F.col("bytes").cast("string"), "sha256").alias("v")
    files = compare_facts(expected.select("path", fact), actual.select("path", fact), "path", "v").select(F.lit("file").alias("rule"), F.col("path").alias("key"), "status")
    twice = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("class"), F.col("class"), F.lit("repeated"))
    n = classes.agg(F.count(F.lit(1)).alias("_n"))
    none = n.where("_n = 0").select(F.lit("class"), F.lit(""), F.lit("no classes"))
    wanted = n.where("_n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_n") - 1, F.lit(0)))).alias("i"))
    spots = wanted.join(classes.groupBy(F.col("class_index").cast("long").alias("i")).agg(F.count(F.lit(1)).alias("c")), "i", "full_outer")
    wrong = spots.where("c is null or c > 1").unionByName(spots.join(n).where("i >= _n and c = 1").select("i", "c")).select(F.lit("class_index"), F.col("i").cast("string"), F.when(F.col("c").isNull(), "missing").otherwise("unexpected"))
    return files.union(twice).union(none).union(wrong)


def cited_facts(docs: DataFrame, key: str, text: str, pattern: str, facts: DataFrame, fact: str) -> tuple[DataFrame, DataFrame]:
    """(citations without a fact, facts that nobody cites): pattern finds citations, group 0."""
    cited = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(fact)).distinct()
    return cited.join(facts.select(fact), fact, "left_anti"), facts.select(fact).distinct().join(cited.select(fact), fact, "left_anti")


def probe_refusals(probes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, accepted, message of every probe, from the violations of all probes."""
    return probes.select(F.col(key).alias("key")).join(first_refusal(found), "key", "left").select("key", F.col("rule").isNull().alias("accepted"), F.coalesce("message", F.lit("")).alias("message"))
