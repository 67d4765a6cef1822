"""Files of prediction tools are read and parsed once."""

from isoframe.sources import tools

GOOD = '{"id": "s", "dr_variants": [{"gene": "g", "change": "c", "drugs": [{"drug": "d", "confidence": ""}]}]}'


def test_status_of_each_file(spark):
    values = [("ok", GOOD), ("text", "{broken"), ("null", None), ("list", "{}"), ("none", '{"dr_variants": []}'), ("drug", GOOD.replace('"d"', '" "')), ("gene", GOOD.replace('"g"', '""')), ("drugs", '{"dr_variants": [{"gene": "g", "change": "c"}]}')]
    texts = spark.createDataFrame(values, "file string, value string")
    told = {r.file: (r.status, r.reason) for r in tools.graded_status(texts).collect()}
    assert told == {"ok": ("ok", ""), "text": ("failed", "not JSON"), "null": ("failed", "not JSON"), "list": ("failed", "no list of resistance variants"), **{f: ("skipped", "no rows") for f in ("none", "drug", "gene", "drugs")}}
    assert {r.file for r in tools.load_graded(texts)[0].collect()} == {"ok"}


def test_filters_do_not_parse_again(spark):
    texts = spark.createDataFrame([("f", GOOD)], "file string, value string")
    for rows in (tools.load_graded(texts)[0], tools.load_species_profiles(texts)[0], tools.load_probes(texts)[0]):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
