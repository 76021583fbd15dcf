"""meterwise: hourly compute-cost monitoring as Spark DataFrame transformations."""
