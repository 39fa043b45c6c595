"""DataFrame-to-DataFrame operators over journeys, polls, predictions and scores."""
