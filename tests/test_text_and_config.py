import copy

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave import config
from kinweave.functions import text

# Names with their normal forms.
NAMES = [
    ("ACME-Industries GmbH.", "acmeindustriesgmbh"),
    ("Bäckerei Müller & Söhne", "backereimullersohne"),
    ("Комисия за защита", "комисиязазащита"),
    ("Ελληνική Δημοκρατία", "ελληνικηδημοκρατια"),
    ("ΔΗΜΟΣ", "δημοσ"),
    ("  123 Holding  ", "123holding"),
    ("... --- !!!", None),
    ("", None),
    (None, None),
]


def test_name_normalisation(spark):
    frame = spark.createDataFrame([(n,) for n, _ in NAMES], "name string")
    found = [r[0] for r in frame.select(text.normalise_name(F.col("name"))).collect()]
    assert found == [expected for _, expected in NAMES]


def test_normalisation_of_letters_equals_the_database(spark):
    codes = [c for c in range(1, 0x2500) if not 0x870 <= c <= 0x8FF]
    rows = [(c, f"a{chr(c)}B") for c in codes]
    found = dict(
        spark.createDataFrame(rows, "c int, s string").select("c", text.normalise_name(F.col("s"))).toPandas().itertuples(index=False)
    )
    frame = spark.createDataFrame(rows, "c int, s string").toPandas()  # noqa: F841
    sql = r"SELECT c, NULLIF(regexp_replace(strip_accents(lower(s)), '[^\p{L}\p{N}]', '', 'g'), '') FROM frame"
    expected = dict(duckdb.sql(sql).fetchall())
    # Letters assigned after the JVM's Unicode version are unknown to it.
    different = [c for c in codes if found[c] != expected[c]]
    assert len(different) <= 6


def test_mention_id_has_no_separator(spark):
    row = spark.range(1).select(text.mention_id(F.lit("a"), F.lit("bc"), F.lit("T")), F.sha2(F.lit("abcT"), 256)).first()
    assert row[0] == row[1]


def test_turtle_escapes(spark):
    row = spark.createDataFrame([('a\\"\n\r\tb',)], "v string").select(text.escape_turtle(F.col("v"))).first()
    assert row[0] == 'a\\\\\\"\\n\\r\\tb'


def test_queue_wait(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:01' c, timestamp'2024-01-01 00:00:02.5' n UNION ALL SELECT timestamp'2024-01-01 00:00:03', timestamp'2024-01-01 00:00:02' UNION ALL SELECT NULL, now()")
    assert [r[0] for r in rows.select(text.queue_wait_ms(F.col("c"), F.col("n"))).collect()] == [1500.0, 0.0, None]


def test_shipped_weights():
    # Weights that follow from the shipped probabilities.
    model = config.shipped().model

    def weights(field):
        return [round(p.weight, 4) for p in model.parameters[field]]

    assert round(model.prior_weight, 4) == -8.3765
    assert weights("legal_name") == [16.4576, 10.5507, 2.6439, -7.6375]
    assert weights("nuts_code") == [4.2016, -3.5699]
    assert weights("post_code") == [5.4094, 2.3219, -2.0, -7.3576]
    assert config.shipped().threshold == 0.7
    assert all(c.field != "country_code" for c in config.shipped().comparisons)


def _with_rules(*rules):
    raw = copy.deepcopy(config.SHIPPED)
    raw["splink"]["blocking_rules"] = list(rules)
    return config.ResolverConfig.from_dict(raw)


def test_all_problems_of_all_rules_are_told_at_once():
    near = {"field": "legal_name", "min_jaro_winkler": 0.8}
    bad = [
        "shoe_size",
        ["country_code", "shoe_size", None],
        {"same": "country_code", "near": near},
        {"same": "country_code", "similar": near | {"field": "post_code"}},
        {"same": "country_code", "similar": near | {"min_jaro_winkler": 80}},
        {"same": "country_code", "similar": near | {"min_jaro_winkler": "0.8"}},
        [],
        3.5,
        {"same": {"field": "country_code"}, "similar": near},
    ]
    with pytest.raises(ValueError) as problem:
        _with_rules(*bad)
    told = str(problem.value)
    assert all(f"blocking rule {number}:" in told for number in range(1, len(bad) + 1))
    for word in ("'shoe_size'", "None", "near.field", "similar.field is missing", "'post_code'", "80", "'0.8'", "a field is missing", "3.5", "same.field"):
        assert word in told, (word, told)


def test_forms_of_rules():
    near = {"same": "nuts_code", "similar": {"min_jaro_winkler": 1, "field": "legal_name"}}
    done = _with_rules("post_code", ["country_code", "post_name"], near).rules
    assert [(r.keys, r.name, r.cutoff) for r in done] == [
        (("post_code",), None, 0.0),
        (("country_code", "post_name"), None, 0.0),
        (("nuts_code",), "legal_name", 1),
    ]


def test_batch_settings_are_read():
    raw = config.SHIPPED | {"batch": {"max_bytes": 1000, "linger_ms": 5}}
    assert config.ResolverConfig.from_dict(raw).batch == config.BatchSettings(1000, 5)
    with pytest.raises(ValueError, match="max_bytes"):
        config.ResolverConfig.from_dict(config.SHIPPED | {"batch": {"max_bytes": 0}})


def test_unknown_comparison_and_missing_rules():
    raw = copy.deepcopy(config.SHIPPED)
    raw["splink"]["comparisons"][0]["type"] = "cosine"
    with pytest.raises(ValueError, match="cosine"):
        config.ResolverConfig.from_dict(raw)
    raw = copy.deepcopy(config.SHIPPED)
    raw["splink"]["blocking_rules"] = []
    with pytest.raises(ValueError, match="blocking_rules"):
        config.ResolverConfig.from_dict(raw)


def test_rule_forms_and_defaults():
    assert config.compound().rules == (config.JoinRule(("country_code", "post_name")),)
    assert [r.keys for r in config.multirule().rules] == [("country_code",), ("post_name",), ("legal_name",)]
    assert config.multirule().model.parameters["legal_name"][0].m == 0.95
