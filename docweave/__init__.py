"""docweave: document analytics as composable DataFrame-to-DataFrame operators on Spark."""
