"""rillframe: terrain, reservoir and table analytics as Spark DataFrame programs."""
