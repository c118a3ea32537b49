"""Sources and sinks: CSV folders of the batch job and views of the benchmark tables."""
