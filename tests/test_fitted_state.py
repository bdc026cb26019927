"""Merged fitted state against a fit on all claims."""

from claimlens.plans import features as FE
from claimlens.plans import fitted_state as FS
from claimlens.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def test_merged_batches_equal_one_fit(spark, tmp_path):
    c, d, p = FX.fixture_tables(spark, SF)
    path = str(tmp_path / "state")
    for k in range(3):  # batches of unequal size
        part = f"id % 7 in ({','.join(map(str, ((0,), (1, 2), (3, 4, 5, 6))[k]))})"
        FS.append(c.where(part), d.where(part), path, f"2024-0{k + 1}")
    first = FS.merged_params(spark, path)
    FS.append(c.where("id % 7 = 0"), d.where("id % 7 = 0"), path, "2024-01")  # again
    again, whole = FS.merged_params(spark, path), FE.fit(c, d, p)
    assert first.modes == again.modes == whole.modes and again.diag_letter_mode == whole.diag_letter_mode
    assert again.facility_vocab == whole.facility_vocab
    checked = FS.rank_checked(FS.median_values(c, d), FS.merged_medians(spark, path)).collect()
    assert len(checked) == 3 and all(r["within"] for r in checked)
    assert FE.transform(c, d, p, again).count() == c.count()
