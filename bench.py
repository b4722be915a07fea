"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``queries``: seconds of each query, its whole result written to nowhere (noop sink).
``kernel``: milliseconds for one synthetic file of 1,000 pages, single-threaded: the
single-file operations that the published micro-benchmarks time.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

HEADLINE = (
    "page_count",
    "object_count",
    "objstm_members",
    "xref_newest_wins",
    "rebuild_last_wins",
    "number_parse",
    "info_text_roundtrip",
    "decode_flate",
    "decode_lzw",
    "decode_predictor_png",
    "inherited_mediabox",
    "xref_findings",
    "page_tree_findings",
    "sound_files",
)


def kernel() -> dict[str, float]:
    import zlib

    from quirelake.functions import filters
    from quirelake.operators import page_tree, shapes
    from quirelake.sources import builder
    from quirelake.sources.reader import PdfFile

    data = builder.build(builder.page_bodies(1000, [b"q Q " * 1000] * 1000))
    raw = b"BT /F1 12 Tf (Hello) Tj ET\n" * 155_000
    packed = zlib.compress(raw)
    step = filters.Chain((filters.Step("FlateDecode"),), "none", "")

    def indexed() -> PdfFile:
        return PdfFile(data).open()

    jobs = {
        "index_1000_pages": indexed,
        "index_and_read_1000_pages": lambda: indexed().load_all(),
        "page_tree_1000_pages": lambda: page_tree.Walk(indexed()),
        "rebuild_1000_pages": lambda: PdfFile(builder.damaged(data, "no-startxref")).open(),
        "shapes_1000_pages": lambda: shapes.check(indexed(), shapes.basic_model()),
        "flate_4mb": lambda: filters.decode(packed, step),
        "flate_4mb_wrong_checksum": lambda: filters.decode(packed[:-4] + b"\x00\x00\x00\x01", step),
    }
    out = {}
    for name, job in jobs.items():
        took = []
        for _ in range(3):
            start = time.perf_counter()
            job()
            took.append(time.perf_counter() - start)
        out[name] = round(1000 * min(took), 2)
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from quirelake.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "kernel_ms": kernel(), "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
