"""DataFrame-to-DataFrame operators over telemetry, splits and activity summaries."""
