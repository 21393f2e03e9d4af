"""siteloom: website audits over tables of collected pages, as Spark jobs."""
