"""Tables: names, layouts, writes, statistics."""
