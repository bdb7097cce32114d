"""wayfare: plan geometry, raster, graph and edit-log analytics as Spark DataFrame operators."""
