"""Getting this package to the Python workers of a session."""

import functools
import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once a session, as --py-files would."""
    top = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".py"))
    mark = hashlib.sha256(b"".join(open(f, "rb").read() for f in files)).hexdigest()[:16]
    name = f"railweave-{mark}.zip"
    if name in spark.sparkContext._python_includes:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="railweave-"), name)
    with zipfile.ZipFile(path, "w") as packed:
        for f in files:
            packed.write(f, os.path.join(os.path.basename(top), os.path.relpath(f, top)))
    spark.sparkContext.addPyFile(path)


def shipped(query):
    """`query`, which takes a session first, with the package shipped before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run
