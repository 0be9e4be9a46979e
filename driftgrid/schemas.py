"""Schemas of the long tables that readers return and operators expect."""

from __future__ import annotations

SCHEMAS = {
    "grid": "cell_id INT, i INT, j INT, lat DOUBLE, lon DOUBLE, area DOUBLE, land TINYINT",
    "cells": "variable STRING, member INT, year INT, month INT, cell_id INT, value FLOAT",
    "series": "member INT, year INT, month INT, value DOUBLE",
    "thresholds": "month INT, threshold DOUBLE, fraction DOUBLE",
    "annual": "member INT, year INT, value DOUBLE",
    "forced_field": "year INT, cell_id INT, value FLOAT",
    "regridded": "year INT, month INT, cell_id INT, value DOUBLE",
    "events": "variable STRING, member INT, month INT, start_year INT, slope DOUBLE, threshold DOUBLE, event TINYINT",
    "indices": "source STRING, index STRING, member INT, year INT, month INT, value DOUBLE, label TINYINT",
    "samples": "split INT, part STRING, member INT, year INT, label TINYINT, features ARRAY<FLOAT>",
    "scores": "split INT, run INT, part STRING, member INT, year INT, y_prob FLOAT, y_true TINYINT",
    "attributions": "split INT, run INT, member INT, year INT, cell_id INT, relevance FLOAT",
    "split_stats": "split INT, mu DOUBLE, sigma DOUBLE",
    "metrics": "split INT, part STRING, run INT, metric STRING, value DOUBLE",
    "history": "split INT, run INT, loss ARRAY<DOUBLE>, val_loss ARRAY<DOUBLE>",
    "manifest": "member_code STRING, member_group STRING, variable STRING, scenario STRING, start_year INT, end_year INT, file STRING",
}
