"""Loads every query module, so that the registry is complete."""

from __future__ import annotations

from crosswin.plans import q_network, q_radio, q_pairing, q_alignment, q_splits, q_features, q_scores, q_reports, q_checks, q_models  # noqa: F401


def flagship(spark, sf_dir):
    return q_network.windows(spark, sf_dir)
