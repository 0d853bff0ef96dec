"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridcalc import Sheet
from gridcalc.queries import KEYS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

#: The published workload's shapes, over lineitem.
FORMULAS = [
    "=E1+F1", "=E1+F2", "=SUM(E1:F2)", "=SUM($E$1:F1)", '=SUMIF(E1:F2,">15")', '=SUMIF($E$1:F1,">15")', "=AVERAGE(E1:F2)", "=AVERAGE($E$1:F1)",
    '=AVERAGEIF(E1:F2,">15")', '=AVERAGEIF($E$1:F1,">15")', '=COUNTIF(E1:F2,">15")', '=COUNTIF($E$1:F1,">15")', "=MAX(E1:F2)", "=MAX($E$1:F1)", '=MAXIF(E1:F2,">15")', '=MAXIF($E$1:F1,">15")',
    "=IF(E1>F1,G1,H1)", "=LOOKUP(B1,A$1:A${n},E$1:E${n},0)", "=LOOKUP(B1,A$1:A${n},E$1:E${n},1)", "=INDEX(E$1:E${n},B1)", "=SUM(E1:F2,G1:H3)", "=SUM(E1:F2,$G$1:H1)", "=AVERAGE(E1:F2,$G$1:H1)", "=MAX(E1:F2,$G$1:H1)",
    "=E1+F2-G3", "=SUM(E1:F2)+G1", '=SUMIF(E1:F2,">15")+G1', "=IF(E1>F1,SUM(E1:F2),AVERAGE(G1:H2))", "=IF(E1>25,SUM(E1:F2),LOOKUP(B1,A$1:A${n},E$1:E${n},0))", "=IF(E1>5,F1,IF(E1<5,G1,H1))",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sheet = Sheet.from_dataframe(spark.read.parquet(f"{SF_DIR}/lineitem.parquet"), KEYS["lineitem"])
    n = sheet.rows
    sheet.numbered().persist().count()
    took = {}
    sheet.compute("=A1").agg(F.count("value")).collect()
    for k, formula in enumerate(FORMULAS, 1):
        began = time.perf_counter()
        sheet.compute(formula.replace("{n}", str(n))).write.format("noop").mode("overwrite").save()
        took[f"f{k:02d}"] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({"metric": "30 formulas over lineitem", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None, "rows": n}))


if __name__ == "__main__":
    main()
