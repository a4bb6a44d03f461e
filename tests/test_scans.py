"""Reports read each of their tables once."""

import re

import pytest

from quarrywork.plans import load_all


@pytest.mark.parametrize("name, scans", [("agent_stats", 1), ("top_types_brief", 1), ("quality_stats", 2)])
def test_one_scan_per_table(name, scans, spark, sf, capsys):
    load_all()[name].build(spark, sf).explain()
    assert len(re.findall(r"FileScan", capsys.readouterr().out)) == scans
