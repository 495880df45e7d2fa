"""What the pipeline leaves in the shared folder."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import corpus_pipeline
from sensorium.session import work_dir

SF = "/root/testdata/sf0.001"


def test_pipeline_leaves_only_its_result(spark):
    folder = urlparse(work_dir(spark)).path
    names = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = names()
    out = corpus_pipeline.run(spark, SF)
    (left,) = names() - before
    assert left.startswith("encoding-") and out.count() > 0
