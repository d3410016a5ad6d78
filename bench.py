"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one line of JSON."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from ridgework.plans import catalog

HEADLINE = (
    "equip_line_eval", "equip_aircraft_eval", "equip_recommend", "equip_meta", "rle_slope", "overlap_matrix", "overlay_join", "slope_distribution", "hex_stencil_cost", "edge_cost_foot", "edge_cost_movers", "accumulated_cost", "viewshed",
    "point_in_polygon", "painted_area", "telemetry_daily", "least_paths",
)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    d = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.local.dir": d, "spark.sql.warehouse.dir": f"{d}/warehouse", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name, at: catalog.QUERIES[name](spark, at).write.format("noop").mode("overwrite").save()
    for name in ("equip_line_eval", "rle_slope"):  # start of the engine, compilation of plans of these shapes
        run(name, sf)
    took = {}
    for name in HEADLINE:
        began = time.time()
        run(name, sf)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
