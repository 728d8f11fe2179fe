"""sectionlens: structure-aware document retrieval and evaluation on Spark."""
