"""What every fit reads is stored first, so that the order lines are joined once."""
import os

import pytest

import __spark_entry__ as entry
from cellweave.operators import models, spectral
from cellweave.plans import tables


class Seen(Exception):
    pass


@pytest.mark.parametrize("module, step, query, at", [(models, "multimodal_baseline", "ML_09_multimodal_baseline", 2), (models, "multimodal_baseline", "ML_10_spatial_multimodal", 2),
                                                     (spectral, "principal_components", "ML_19_integration_alternatives", 1)])
def test_fits_read_stored_values(spark, monkeypatch, module, step, query, at):
    def first(*args, **named):
        plan = args[at]._jdf.queryExecution().optimizedPlan().toString()
        raise Seen("Relation" in plan or "Join" in plan)

    monkeypatch.setattr(module, step, first)
    with pytest.raises(Seen) as seen:
        entry.queries()[query](spark, "/root/testdata/sf0.001").collect()
    assert seen.value.args == (False,)


def test_a_frozen_roi_sums_no_counts_of_other_cells(spark, monkeypatch):
    monkeypatch.setattr(tables, "_ATLASES", {})
    assert entry.queries()["SNK_05_roi_freeze"](spark, "/root/testdata/sf0.001").count() == 1
    atlas, = tables._ATLASES.values()
    assert os.listdir(atlas._path.removeprefix("file:")) == ["cells"]
