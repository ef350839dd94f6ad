"""All queries with SQL at one scale: python tests/sweep.py SF_DIR [NAME ...]; prints what differs and the seconds."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    db, sql, bad = compare.duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            left = compare.rows_of_spark(query(spark, sf_dir))
            took = time.time() - began
            said = compare.difference(left, compare.rows_of_duck(db, sql[name])) if name in sql else ""
        except Exception:
            took, said = time.time() - began, traceback.format_exc()[-1500:]
        bad += bool(said)
        print(f"{name}: {'FAIL ' + said if said else f'{len(left[1])} rows'} {took:.1f} s {time.time() - began - took:.1f} s{'' if name in sql else ' (rows only)'}", flush=True)
        spark.catalog.clearCache()
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
