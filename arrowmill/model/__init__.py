"""What queries are checked against: classes, associations and their tables."""
