"""functions of the event-log repair library."""
