"""Document-layout analytics on Spark: DataFrame operators over tables of positioned page content."""
