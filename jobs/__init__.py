"""Jobs that run the library's operators over given tables; each has a command line and a small config file."""
