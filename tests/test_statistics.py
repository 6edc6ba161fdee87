import numpy as np
import pytest

from tallyloom.functions import resampling as R


def test_mean_interval():
    got = R.mean_interval([1, 1, 1, 0, 0])
    assert got["mean"] == 0.6 and got["ci_low"] <= 0.6 <= got["ci_high"] and got["method"] == "BCa"
    assert R.mean_interval([2, 2, 2])["method"] == "degenerate"
    assert R.mean_interval([])["n"] == 0 and R.mean_interval([])["mean"] is None


def test_paired_delta():
    got = R.paired_delta([1, 1, 1, 0], [0, 0, 0, 0])
    assert got["delta"] == 0.75 and got["n"] == 4
    assert R.paired_delta([1, 1], [0, 0])["significant"] is False


COST_A, JOINT_A = [0.002] * 7 + [0.020], [1, 1, 1, 1, 1, 1, 0, 0]
COST_B, JOINT_B = [0.004] * 8, [1, 0] * 4


def test_ratio_delta():
    got = R.ratio_delta(COST_A, JOINT_A, COST_B, JOINT_B)
    assert got["delta"] == pytest.approx(sum(COST_A) / 6 - sum(COST_B) / 4)
    flat = R.ratio_delta([0.002] * 4, [1] * 4, [0.004] * 4, [1] * 4)
    assert flat["delta"] == pytest.approx(-0.002) and flat["method"] == "degenerate" and flat["significant"]
    assert R.ratio_delta(COST_A, [0] * 8, COST_B, JOINT_B)["delta"] is None


def test_permutations():
    p = R.ratio_swap_p(COST_A, JOINT_A, COST_B, JOINT_B)
    assert (p * 256) == pytest.approx(round(p * 256))
    assert R.ratio_swap_p(COST_A, JOINT_A, COST_A, JOINT_A) == 1.0
    assert R.ratio_swap_p([1], [1], [2], [1]) is None
    assert R.sign_flip_p([0, 0]) is None and R.sign_flip_p([1.0]) is None
    assert R.sign_flip_p([1, 1, 1, 1]) == pytest.approx(2 / 16)


def test_normal_quantile():
    assert R.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert np.isinf(R.normal_quantile(1.0))
