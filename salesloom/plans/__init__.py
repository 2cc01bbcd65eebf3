"""The retail model and the reports written on it."""
