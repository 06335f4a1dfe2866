"""Reading stat pages, typing raw records and keeping season snapshots."""
