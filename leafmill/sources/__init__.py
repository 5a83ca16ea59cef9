"""Where catalogs come from: tables, and directory trees."""
