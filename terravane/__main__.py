"""python -m terravane run SPEC | spec-template"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="terravane")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a job specification")
    run.add_argument("spec", help="a JSON file, on any file system that Spark reads")
    sub.add_parser("spec-template", help="print a specification to fill in")
    args = p.parse_args(argv)
    from terravane.plans import measure

    if args.command == "spec-template":
        print(json.dumps(measure.TEMPLATE, indent=2))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    spec = json.loads(spark.read.text(args.spec, wholetext=True).first()[0])
    r = measure.run_spec(spark, spec).first()
    print(f"net {r['net_volume_m3']:.2f} m3 | cut {r['cut_volume_m3']:.2f} | fill {r['fill_volume_m3']:.2f} | area {r['area_m2']:.1f} m2")


if __name__ == "__main__":
    main()
