"""The problems of TESTDATA.md on small inputs."""

import __spark_entry__ as entry
from linematch.functions.segments import values_of
from linematch.sources.feed import loaded_entries, rejected_lines

LINES = [
    (1, "sku,canonical_name,category,aliases\r", None),
    (2, 'GRN0195 ,"Maize, dry",Grains,makai|maize\r', None),
    (3, '"GRN0195","Jar 8"" size" ,Grains,', None),
    (4, 'GRN0195,Maize "big",Grains,makai', "broken_quote"),
    (5, 'HSH0153,"Comb', "broken_quote"),
    (6, 'HSH0153,"Comb"*,Household,', "broken_quote"),
    (7, "HSH0153,Comb,Household", "column_count"),
    (8, "HSH0153\tComb\tHousehold\tkangha", "column_count"),
    (9, "HSH-153,nil,Household,", "bad_sku"),
    (10, "hsh0153,Comb,Household,", "bad_sku"),
    (11, "HSH0153,NULL,Household,", "bad_name"),
    (12, "HSH0153,12345,Household,", "bad_name"),
    (13, "HSH0153,Ke\x07ab,Household,", "bad_name"),
    (14, "HSH0153,Tav�,Household,", "bad_name"),
    (15, "HSH0153,कंघी,Household,a\\c|b\\b", None),
    (16, "# a remark", None),
    (17, " \r", None),
    (18, "HSH0153," + '"x, ""y"""' * 1 + ",Household," + "|".join(["a"] * 40), None),
    (19, ",".join(['"q"'] * 20000), "column_count"),
]


def test_feed_lines(spark):
    lines = spark.createDataFrame([("f", n, t) for n, t, _ in LINES], "feed_id string, line_no int, line string")
    assert {r.line_no: r.reason for r in rejected_lines(lines).collect()} == {n: r for n, _, r in LINES if r}
    loaded = {r.line_no: r for r in loaded_entries(lines).collect()}
    assert sorted(loaded) == [2, 3, 15, 18]
    assert (loaded[2].sku, loaded[2].canonical_name, loaded[2].aliases) == ("GRN0195", "Maize, dry", ["makai", "maize"])
    assert loaded[3].canonical_name == 'Jar 8" size'
    assert loaded[15].aliases == ["a\\c", "b\\b"]
    assert loaded[18].canonical_name == 'x, "y"' and len(loaded[18].aliases) == 40


def test_values_of():
    assert values_of('1,25 Kilogram\tboxes') == ["1,25 Kilogram", "boxes"]
    assert values_of('"8"" carrot, sliced" |  carrot/gajar||') == ['8" carrot, sliced', "carrot", "gajar"]
    assert values_of(' ["½ kgs", "1/4 किलो"]') == ["½ kgs", "1/4 किलो"]
    assert values_of("{a,b}") == ["a", "b"]
    assert values_of("૧,૫ કિલો/१/२ kg；3 g•x¦y") == ["૧,૫ કિલો", "१/२ kg", "3 g", "x", "y"]
    assert values_of("extra (large); ready & quick\n\ngrade A+") == ["extra (large)", "ready & quick", "grade A+"]
    assert values_of(None) == values_of(' , "" ;') == []
    assert values_of('"open;b') == ['"open', "b"]


def test_known_values_protect_their_marks():
    from linematch.functions.segments import automaton

    known = automaton(["salt, iodised", "salt", "a/b/c", "b", "ghee; pure"])
    assert values_of("Salt, Iodised, salt|x", known) == ["Salt, Iodised", "salt", "x"]
    assert values_of("a/b/c/b; ghee; pure", known) == ["a/b/c", "b", "ghee; pure"]
    assert values_of("xsalt, iodised;salt, iodisedx", known) == ["xsalt", "iodised", "salt", "iodisedx"]
    assert values_of('"salt", iodised', known) == ["salt", "iodised"]
    assert automaton(["", " "]) is None


def test_packed_values(spark):
    from linematch.functions.segments import packed_values

    rows = [(1, "a|a", None, "1 kg"), (2, None, '"x;y"', "")]
    entries = spark.createDataFrame(rows, "entry_id long, aliases string, ocr_errors string, units string")
    assert sorted(map(tuple, packed_values(entries).collect())) == [(1, "aliases", 1, "a"), (1, "aliases", 2, "a")]


def test_registered():
    assert {"p3_found", "p4_found", "p5_found"} <= set(entry.queries())


def test_amounts(spark):
    from linematch.functions.amounts import amounts_to_convert

    texts = {
        "rice 4 Kilogram 250 g": ("g", 4250),
        "rice 50 kgs x 10": ("g", 500000),
        "rice : 10 x 0.5 kg": ("g", 5000),
        "1½ Dozen: rice": ("piece", 18),
        "rice - 2 1/2 Kg": ("g", 2500),
        "keri.. aadha kilo": ("g", 500),
        "rice one and a half kg": ("g", 1500),
        "તલ - અઢી કિલો": ("g", 2500),
        "सवा लीटर": ("ml", 1250),
        "8) Okra 0,25kgms loose": ("g", 250),
        "rice ２５０ ｇｒａｍｍｅ": ("g", 250),
        "d\u200dedh kilo": ("g", 1500),
        "ha1meru 5yrup, 3 pav": ("g", 750),
        "soap 2 pairs": ("piece", 4),
        "soap 7 box": None,
        "soap 50 rs": None,
        "8) soap": None,
    }
    rows = [(n, t, 7.0, None, "none") for n, t in enumerate(texts)]
    rows += [(100, "rice 5", 5.0, None, "bulk"), (101, "rice 5 g", 5.0, "g", "bulk"), (102, "rice 5 box", 5.0, None, "bulk")]
    items = spark.createDataFrame(rows, "item_id long, raw_text string, quantity double, unit string, source_code string")
    entries = spark.createDataFrame(
        [(1, None, None, "1,25 Kilogram|box|250 g|½ kg|kg"), (2, None, None, "५ लीटर")],
        "entry_id long, aliases string, ocr_errors string, units string",
    )
    sources = spark.createDataFrame([("none", None), ("bulk", "kg")], "source_code string, default_unit string")
    factors = {"g": ("g", 1.0), "kg": ("g", 1000.0), "pav": ("g", 250.0), "ml": ("ml", 1.0), "liter": ("ml", 1000.0)}
    factors |= {"piece": ("piece", 1.0), "pair": ("piece", 2.0), "dozen": ("piece", 12.0), "box": (None, None), "rupee": (None, None)}
    units = spark.createDataFrame([(k, *v) for k, v in factors.items()], "unit string, base_unit string, factor double")
    got = {(r.src_table, r.rec_id, r.pos): (r.base_unit, r.base_amount) for r in amounts_to_convert(items, entries, sources, units).collect()}
    want = {("list_items", n, 0): v for n, v in enumerate(texts.values()) if v} | {("list_items", 100, 0): ("g", 5000)}
    want |= {("vendor_catalog", 1, 1): ("g", 1250), ("vendor_catalog", 1, 4): ("g", 500), ("vendor_catalog", 2, 1): ("ml", 5000)}
    assert got == want
