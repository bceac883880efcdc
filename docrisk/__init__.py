"""docrisk: bulk screening of financial documents and chain addresses on Spark."""
