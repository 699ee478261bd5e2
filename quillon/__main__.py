"""python -m quillon FOLDER REPORT: analyses the mails of a folder with the built-in rules."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quillon.plans.analyze import Config, process_directory


def main(args: list[str]) -> int:
    config = Config()
    folder, report = (args + [config.input_dir, config.report][len(args) :])[:2]
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    print(f"{process_directory(spark, folder, report)} mails analysed, report in {report}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
