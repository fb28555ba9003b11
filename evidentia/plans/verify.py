"""python -m evidentia.plans.verify DIR [QUERY...]: every query against its SQL."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from evidentia.plans import compare, registry


def main(sf_dir: str, names: list[str]) -> int:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    bad = {n: x for n in names or registry.ORACLES if (x := compare.differences(spark, registry.QUERIES[n], registry.ORACLES[n], sf_dir))}
    for name, what in bad.items():
        print(f"{name}: {what}")
    print(f"{len(names or registry.ORACLES) - len(bad)} agree, {len(bad)} differ")
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
