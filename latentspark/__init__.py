"""Partial least squares and its inference on Spark DataFrames."""

from latentspark.operators.calibration import pls1_calibration
from latentspark.operators.fit import pls1_fit, pls1_predict, preprocess, rotate, scores, spls1_fit
from latentspark.operators.inference import pls1_confirmatory_test, pls1_perm_null, split_nb_gate
from latentspark.operators.rotation_stability import pls1_rotation_stability
from latentspark.operators.selection import pls1_find_k_optimal, pls1_find_k_sequence, spls1_find_k_optimal, spls1_find_k_sequence, spls1_find_keep_optimal
from latentspark.sources.frame import Frame, feature_frame, read_frame

__version__ = "0.1.0"


def version() -> str:
    return __version__


__all__ = ["Frame", "feature_frame", "pls1_calibration", "pls1_confirmatory_test", "pls1_find_k_optimal", "pls1_find_k_sequence", "pls1_fit", "pls1_perm_null", "pls1_predict", "pls1_rotation_stability", "preprocess", "read_frame", "rotate", "scores", "split_nb_gate", "spls1_find_k_optimal", "spls1_find_k_sequence", "spls1_find_keep_optimal", "spls1_fit", "version"]
