"""Job-posting extraction over tables and streams of captured pages."""
