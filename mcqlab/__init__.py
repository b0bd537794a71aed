"""mcqlab: evaluate generated multiple-choice questions and build preference data with Spark."""
