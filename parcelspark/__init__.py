"""parcelspark: parcel-level housing-feasibility analytics as Spark jobs."""
