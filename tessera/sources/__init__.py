"""Reading and writing tables, relations and documents."""
