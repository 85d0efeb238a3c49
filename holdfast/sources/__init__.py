"""Raw table contracts, CSV ingest and table storage."""
