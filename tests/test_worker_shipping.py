"""Python workers get this package from the driver: they need not have it."""

import os
import subprocess
import sys
import tempfile

from pyspark import SparkFiles

from rivulet import session


def test_shipped_package_is_enough_for_the_scorer(spark):
    session._SHIPPED.discard(spark.sparkContext.applicationId)
    session.ship_package(spark)
    path = os.path.join(SparkFiles.getRootDirectory(), "rivulet_operators.zip")
    code = ("import sys; sys.path.insert(0, %r); import numpy as np; from rivulet.operators.scoring import ItemBlock; "
            "import rivulet; assert rivulet.__file__.startswith(%r); none = np.zeros(0, int); "
            "print(ItemBlock(np.eye(3), np.zeros(3)).best_unseen(-np.array([[2.0, 1.0, 1.0]]), np.zeros(1), none, none, 2)[1].tolist())") % (path, path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.gettempdir(), env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "[1, 2]"
