"""Reading landed files and tables, seed reference tables, and table writes."""
