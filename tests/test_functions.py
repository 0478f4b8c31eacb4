import hashlib

from pyspark.sql import functions as F

from shardloom.functions import expressions as X
from shardloom.functions import vectors as V
from shardloom.functions.draws import draw_int


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(values[n], (str, type(None))) else 'array<double>' if isinstance(values[n], list) else 'long'}" for n in names))
    return df.select(column.alias("x")).first().x


def test_draws_are_the_hash_of_their_key(spark):
    want = int(hashlib.sha256(b"a|7|b").hexdigest()[:15], 16)
    assert one(spark, draw_int("a", 7, F.col("k")), k="b") == want


def test_crop_rounds_half_to_even_and_centres(spark):
    g = one(spark, X.crop_geometry(F.col("w"), F.col("h"), 512), w=800, h=600)
    assert (g.width, g.height, g.left, g.top, g.centre_cropped) == (683, 512, 85, 0, True)


def test_paths_must_agree_with_themselves(spark):
    ok, nok = r"^SET/([A-C])_ok/([A-C])_ok_\d{5}\.jpg$", r"^SET/([A-C])_nok/(train|val|test)/(scratches|spots)/([A-C])_(sc|sp)_(train|val|test)_\d{5}\.jpg$"
    rows = spark.createDataFrame([(p,) for p in ("SET/A_ok/A_ok_00001.jpg", "SET/A_ok/B_ok_00001.jpg", "SET/B_nok/val/spots/B_sp_val_00003.jpg", "SET/B_nok/val/spots/B_sc_val_00003.jpg", "SET/B_nok/val/spots/B_sp_test_00003.jpg")], "p string")
    got = [(r.g.product, r.g.label, r.g.official_split) if r.g.ok else None for r in rows.select(X.parse_path(F.col("p"), ok, nok).alias("g")).collect()]
    assert got == [("A", "normal", ""), None, ("B", "spots", "val"), None, None]


def test_terms_stand_between_non_letters_in_list_order(spark):
    t = one(spark, X.extract_terms(F.col("t")), t="A diagonal, THIN line. outline streaked")
    assert t.shape == ["thin", "diagonal", "line"] and t.texture == []
    assert one(spark, X.description_problems(F.col("t"), ("shape", "texture")), t="I cannot tell.") == ["no whitelisted shape/texture term"]
    assert one(spark, X.description_problems(F.col("t"), ("shape",)), t=" ") == ["empty description"]
    assert one(spark, X.description_problems(F.col("t"), ("shape",)), t=None) == ["empty description"]


def test_vectors(spark):
    assert one(spark, V.argmax(F.col("v")), v=[1.0, 3.0, 3.0]) == 1
    assert one(spark, V.centred_unit(F.col("v")), v=[2.0, 2.0]) == [0.0, 0.0]
    p = one(spark, V.softmax(F.col("v")), v=[1000.0, 1000.0])
    assert p == [0.5, 0.5]
    assert one(spark, V.valid_vector(F.col("v"), 2), v=[1.0, float("nan")]) is False
    assert abs(one(spark, V.cosine100(F.col("v"), F.col("v")), v=[3.0, 4.0]) - 100) < 1e-9


def test_labels_and_urls(spark):
    assert one(spark, X.humanise_label(F.col("l")), l="scratches") == "scratch" and one(spark, X.humanise_label(F.col("l")), l="dark_spots") == "dark spots"
    u = one(spark, X.source_urls("b", "p", F.col("k"), F.lit("exe"), F.col("k")), k=5)
    assert u.object_url is None and u.page_url == "p/5"
