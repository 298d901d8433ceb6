"""furrow: survey-table analytics and corpus preparation as PySpark plans."""
