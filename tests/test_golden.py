"""Known results on the clinical datasets. Their files are not part of this repository:
set LOOFOLD_CLINICAL to a folder that holds <dataset>.csv to run these."""

import os

import pytest

from loofold.functions.metrics import mcc_binary
from loofold.plans.evaluate import evaluate
from loofold.sources.catalog import KNOWN_CATEGORICAL
from loofold.sources.tables import read_csv, with_row_id

FOLDER = os.environ.get("LOOFOLD_CLINICAL", "")
RESULTS = {
    "neuroblastoma": (54, 69, 23, 23, 0.451299),
    "heart_failure": (277, 116, 10, 22, 0.826138),
    "cardiac_arrest": (170, 101, 87, 64, 0.268619),
    "diabetes": (31, 12, 13, 11, 0.222152),
}


@pytest.mark.skipif(not FOLDER, reason="LOOFOLD_CLINICAL is not set")
@pytest.mark.parametrize("dataset", list(RESULTS))
def test_clinical(spark, dataset):
    df = with_row_id(read_csv(spark, os.path.join(FOLDER, f"{dataset}.csv")))
    result = evaluate(df, KNOWN_CATEGORICAL[dataset], df.columns[-1], "row_id")
    row = mcc_binary(result.predictions).first()
    assert tuple(row)[:4] == RESULTS[dataset][:4]
    assert row["mcc"] == pytest.approx(RESULTS[dataset][4], abs=1e-6)
