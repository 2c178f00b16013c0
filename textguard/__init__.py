"""Text-security analytics on Spark: scan, mask, decide, audit and measure
large tables and streams of prompts, documents and conversations."""
