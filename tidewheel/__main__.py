"""python -m tidewheel --config FILE --input_dir DIR --output_dir DIR"""

import argparse

from pyspark.sql import SparkSession

from tidewheel.plans.forecast import run_files
from tidewheel.plans.settings import Settings


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewheel", description="Forecast each store's sales and report the errors.")
    parser.add_argument("--config", required=True, help="YAML file of settings")
    parser.add_argument("--input_dir", required=True, help="folder of the sales and store tables")
    parser.add_argument("--output_dir", required=True, help="folder for journals, models and predictions")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidewheel").getOrCreate()
    out = run_files(spark, Settings.from_yaml(given.config, given.input_dir, given.output_dir))
    print(f"MAE {out.metrics.mae:.2f}, RMSE {out.metrics.rmse:.2f}, MAPE {out.metrics.mape:.2f} %")


if __name__ == "__main__":
    main()
