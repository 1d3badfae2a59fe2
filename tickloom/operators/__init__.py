"""DataFrame -> DataFrame operators over bars, calendars, observations, posts and quotes."""
