"""Linkage in several runs equals one run over all rows."""

from pyspark.sql import functions as F

from attestor.operators import linkage, relink
from tests_support import PUB_SCHEMA, TRIAL_SCHEMA, publication

A = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
B = "red orange yellow green blue indigo violet black white grey"


def test_runs_add_up(spark):
    def pubs(*rows):
        return spark.createDataFrame([(*r, v) for r, v in rows], PUB_SCHEMA + ", version int")

    early = [
        (publication("1", title=A.replace("kappa", "lambda mu nu")), 1),  # the best for NCT01 until 5 comes
        (publication("2", title=B), 1),  # the best for NCT02 until its title changes
        (publication("3", title="by id", secondary_ids=["NCT03"]), 1),
        (publication("4", title="one two three four five six"), 1),  # nothing of it changes
    ]
    late = [
        (publication("5", title=A), 1),
        (publication("2", title="something else altogether now"), 2),
        (publication("1", title="an older text", year="1999"), 0),  # an earlier version changes nothing
        (publication("6", title=B.replace("grey", "pink")), 1),
        (publication("7", title="by id again", secondary_ids=["NCT03"]), 1),  # now two articles carry the id
        (publication("4", title="one two three four five six"), 1),  # delivered again as it was
    ]
    trials = [("NCT01", A, "", "2020", ""), ("NCT02", B, "", "2020", ""), ("NCT03", B, "", "2020", ""), ("NCT04", "one two three four five six", "", "2020", "")]
    more = [("NCT05", A, "", "2020", ""), ("NCT04", "one two three four five six", "", "2020", "")]
    known = relink.first_linkage(spark.createDataFrame(trials, TRIAL_SCHEMA), pubs(*early))
    assert {r.nct_id: r.pmid for r in known.linked.collect()} == {"NCT01": "1", "NCT02": "2", "NCT03": "3", "NCT04": "4"}
    now, changed = relink.relink(known, spark.createDataFrame(more, TRIAL_SCHEMA), pubs(*late))
    whole = linkage.link(spark.createDataFrame([*trials, more[0]], TRIAL_SCHEMA), pubs(*early, *late))
    columns = whole.columns
    assert sorted(map(tuple, now.linked.select(columns).collect())) == sorted(map(tuple, whole.collect()))
    assert {r.nct_id: r.pmid for r in now.linked.collect()} == {"NCT01": "5", "NCT02": "6", "NCT03": "6", "NCT04": "4", "NCT05": "5"}
    assert {r.nct_id for r in changed.collect()} == {"NCT01", "NCT02", "NCT03", "NCT05"}
    again, nothing = relink.relink(now, spark.createDataFrame(more, TRIAL_SCHEMA).limit(0), pubs(*late))
    assert nothing.count() == 0 and again.linked.select(F.count("*"), F.count_distinct("nct_id")).first() == (5, 5)
