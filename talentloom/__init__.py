"""talentloom: candidate/job matching analytics as PySpark DataFrame jobs."""
