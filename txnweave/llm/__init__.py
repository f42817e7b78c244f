"""Training-data operators: deduplication, scoring, sharding, decontamination,
tokenisation, quality rules, binary output, archives and secret scans."""
