import os

from pyspark.sql import SparkSession


def make(app="mdframes", cores=8):
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.host", "127.0.0.1").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from mdframes.packaging import ship
    ship(spark)
    return spark
