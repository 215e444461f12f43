"""thresher: schema-on-read extraction of structured records from web pages, on Spark."""
